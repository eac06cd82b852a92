r"""Decomposition of markup into a tree of nodes, one row per node.

One pass over the tokens of a document with a stack of open nodes: headings, ``\begin`` and
``\end``, items, math delimiters, labels, verbatim. A node's body holds a placeholder for
each child, so bodies and tree together reproduce the text. Rows of multi-row math are nodes
from the start, so what a row holds has the row as its parent. Each node has the position of
its last descendant, so a subtree is an interval, and of the nodes around it that others ask for,
which the parser's stack knows. Documents are independent; the pass runs in Arrow
batches, and everything after it is joins and windows on the node table.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ENV_COUNTERS, ENVIRONMENTS, LISTS, MULTILINE_MATH, PAGE_MARKERS, SECTION_LEVELS, VERBATIM
from ..functions.rules import apply_literals
from ..functions.scanner import Groups
from ..session import ship

#: ``section`` is the innermost heading around a node, ``near`` the innermost node that carries a number, itself included, ``float`` the
#: figure or table that holds it directly or through layout, ``place`` an item's place in the lists around it, ``outer`` its parent's ordinal,
#: ``page`` the chapter or section whose page a node is on, itself included, or the document, and ``above`` the page that its parent is on.
NODES = (
    "doc_id long, pos int, parent int, ordinal int, depth int, last int, section int, near int, float int, place string, outer int, marker string, star boolean, "
    "title string, option string, label string, body string, opening string, closing string, page int, above int"
)
#: A child in its parent's body: the child's position between these two.
OPEN, CLOSE = "\u27e6", "\u27e7"
PLACEHOLDER = OPEN + "([0-9]+)" + CLOSE
#: A document's own placeholder signs are escaped by a private character and a letter.
ESCAPE = "\ue000"
_ESCAPES = {ord(OPEN): ESCAPE + "a", ord(CLOSE): ESCAPE + "b", ord(ESCAPE): ESCAPE + "c"}

# Every alternative begins with a plain sign, so that the search skips other text, and tells itself apart by the next one. Of other
# commands only an escaped dollar is a token: what stands behind the backslash of all others begins none.
_TOKEN = re.compile(
    r"\\(?:begin\{(?P<begin>[A-Za-z]+)(?P<bstar>\*?)\}"
    r"|end\{(?P<end>[A-Za-z]+)\*?\}"
    r"|item\b[ \t]*(?P<item>)"
    r"|label\{(?P<label>[^}]*)\}"
    r"|verb\*?(?P<vd>[^A-Za-z\s*])(?P<verb>.*?)(?P=vd)"
    r"|(?P<sec>chapter|section|subsection|subsubsection|worksheet|exercises|paragraphs)(?P<sstar>\*?)\s*(?=\{)"
    r"|(?P<delim>[\[\]()])"
    r"|\\(?P<row>(?:\[[^\[\]&]*\])?)"
    r"|cr(?![A-Za-z])(?P<cr>)"
    r"|\$)"
    r"|\$(?P<dollar>\$?)",
    re.S,
)
_LEVEL = {m: k for k, m in enumerate([*SECTION_LEVELS, "exercises", "worksheet", "paragraphs"])}
_INLINE_CLOSE = {"$": "$", "$$": "$$", "(": ")", "[": "]"}
_ROW = re.compile(r"(\\\\(?:\[[^\[\]&]*\])?|\\cr(?![A-Za-z]))")
_LABEL = re.compile(r"\\label\{([^}]*)\}")
_COUNTED = {m for _, _, counter, names in ENVIRONMENTS if counter in (*ENV_COUNTERS, *SECTION_LEVELS) for m in names.split()}
_FLOATS = {m for c, _, _, names in ENVIRONMENTS if c == "figure" for m in names.split()}
_LAYOUT = {m for c, _, _, names in ENVIRONMENTS if c == "layout" for m in names.split()} - set(VERBATIM) - {"footnote"}
#: What a marker is, as bits: asked once for each node.
_SECTION, _PAGE, _COUNT, _FLOAT, _LAYS_OUT, _HEAD, _LIST = (1 << k for k in range(7))
_GROUPS = ((_SECTION, SECTION_LEVELS), (_PAGE, PAGE_MARKERS), (_COUNT, _COUNTED), (_FLOAT, _FLOATS), (_LAYS_OUT, _LAYOUT), (_HEAD, _LEVEL), (_LIST, LISTS))
_STACKED = _HEAD | _LIST
_BITS = {m: sum(bit for bit, names in _GROUPS if m in names) for _, names in _GROUPS for m in names}


class _Node:
    """An open node; what others ask of it is held as positions, so that a closed one can go."""

    __slots__ = ("pos", "parent", "marker", "bits", "opening", "closing", "star", "option", "title", "label", "parts", "children", "ordinal", "depth", "items", "section", "near", "float", "page", "place")

    def __init__(self, pos: int, parent: _Node | None, marker: str, opening: str, star: bool = False, option: str = "", title: str = ""):
        self.pos, self.parent, self.marker, self.opening, self.closing = pos, parent, marker, opening, ""
        self.star, self.option, self.title, self.label, self.parts, self.children, self.items = star, option, title, "", [], 0, 0
        bits = self.bits = _BITS.get(marker, 0)
        if parent is None:
            self.ordinal = self.depth = 0
            self.section = self.near = self.float = None
            self.page, self.place = pos, ""
            return
        parent.children += 1
        self.ordinal, self.depth = parent.children, parent.depth + 1
        parent.parts.append(f"{OPEN}{pos}{CLOSE}")
        self.section = parent.pos if parent.bits & _SECTION else parent.section
        self.near = pos if bits & _COUNT else parent.near
        self.page = pos if bits & _PAGE else parent.page
        self.float = self if bits & _FLOAT else parent.float if bits & _LAYS_OUT else None
        self.place = parent.place
        if marker == "item":
            parent.items += 1
            self.place = f"{parent.place}.{parent.items}" if parent.place else str(parent.items)

    def row(self, doc_id: int, last: int) -> tuple:
        up, held = self.parent, self.float
        place = self.place if self.marker == "item" else None
        held, self.float = None if held is None else held.pos, None  # no cycles are left behind
        above = (None, None, None) if up is None else (up.pos, up.ordinal, up.page)
        return (doc_id, self.pos, above[0], self.ordinal, self.depth, last, self.section, self.near, held, place, above[1], self.marker, self.star, self.title, self.option, self.label, "".join(self.parts), self.opening, self.closing, self.page, above[2])


#: Rows that are handed on together, however large or small the documents are.
CHUNK = 8192


def parse(text: str, doc_id: int = 0) -> list[tuple]:
    """The nodes of one document in depth-first order; the document itself is position 0."""
    return sorted((row for rows in closed_nodes(text, doc_id) for row in rows), key=lambda row: row[1])


def closed_nodes(text: str, doc_id: int = 0, chunk: int = CHUNK, kind_of: type = _Node) -> Iterator[list[tuple]]:
    """The nodes of one document in lists of some ``chunk`` rows, as they close: only what is open is held.

    ``kind_of`` is the class of nodes, whose ``row`` says what leaves of a node that closes.
    """
    opened = [kind_of(0, None, "document", "")]
    counts: dict[str, int] = {}  # of the open nodes, by marker
    heads: list[int] = []  # where in the stack headings are
    lists = 0
    count = 1
    rows: list[tuple] = []
    ended: set[str] = set()
    braces, brackets = Groups(text), Groups(text, "[", "]")

    def find(sign: str, at: int) -> int:
        """Where a sign stands next; one that is not found stands nowhere behind either."""
        stop = -1 if sign in ended else text.find(sign, at)
        if stop < 0:
            ended.add(sign)
        return stop

    def open_node(marker: str, opening: str, star: bool = False, option: str = "", title: str = "") -> _Node:
        nonlocal count, lists
        node = kind_of(count, opened[-1], marker, opening, star, option, title)
        count += 1
        counts[marker] = counts.get(marker, 0) + 1
        if node.bits & _STACKED:
            if node.bits & _HEAD:
                heads.append(len(opened))
            if node.bits & _LIST:
                lists += 1
        opened.append(node)
        return node

    def pop() -> _Node:
        nonlocal lists
        node = opened.pop()
        counts[node.marker] -= 1
        if node.bits & _STACKED:
            if node.bits & _HEAD:
                heads.pop()
            if node.bits & _LIST:
                lists -= 1
        return node

    def close_to(depth: int) -> None:
        last = count - 1
        while len(opened) > depth:
            rows.append(pop().row(doc_id, last))

    def open_row() -> None:
        open_node("mathrow", "")

    def end_row(closing: str) -> None:
        """Close the row on top of the stack; an empty last row was none."""
        nonlocal count
        row = pop()
        owner = opened[-1]
        row.closing = closing
        body = "".join(row.parts)
        row.star = owner.star or closing.startswith("\\cr") or "\\nonumber" in body
        if not closing:
            row.option = "end"
            if row.pos == count - 1 and not body.strip():
                count -= 1
                owner.children -= 1
                owner.parts[-1] = body
                return
        rows.append(row.row(doc_id, count - 1))

    def option_at(at: int) -> int:
        """Where a bracketed option at a place ends; the place itself without one."""
        if not text.startswith("[", _BLANK.match(text, at).end()):
            return at
        start, end = brackets.group_at(at)
        return end if end > start else at

    at = 0
    search = _TOKEN.search
    while (m := search(text, at)) is not None:
        top = opened[-1]
        start, end = m.span()
        if start > at:
            top.parts.append(text[at:start])
        at = end
        kind = m.lastgroup
        if len(rows) >= chunk:
            yield rows
            rows = []
        if kind is None:
            top.parts.append(text[start:end])
        elif kind == "bstar":
            name, bstar = m.group("begin", "bstar")
            sign = text[at : at + 1]
            if (sign == "[" or sign.isspace()) and name != "equation":  # there a bracket is content
                at = option_at(at)
            option = text[end:at].strip()[1:-1] if at > end else ""
            node = open_node(name, text[start:at], bstar != "" or name == "split", option)
            if name in MULTILINE_MATH:
                open_row()
            elif name in VERBATIM:
                stop = find(f"\\end{{{name}", at)
                if stop >= 0:
                    node.parts.append(text[at:stop])
                    at = stop
        elif kind == "end":
            name = m.group("end")
            if counts.get(name):
                held = len(opened) - 1  # what is passed on the way to the innermost of its kind closes with it
                while opened[held].marker != name:
                    held -= 1
                opened[held].closing = text[start:end]
                if name in MULTILINE_MATH and len(opened) == held + 2:
                    end_row("")
                close_to(held)
            else:  # closes nothing: ordinary text
                top.parts.append(text[start:end])
        elif kind == "label":
            # What only lays out hands its label to the figure around it.
            owner = top.float if top.float is not None and not top.float.label else top
            if not owner.label:
                owner.label = m.group("label")
            top.parts.append(text[start:end])
        elif kind == "sstar":
            marker = m.group("sec")
            start, at = braces.group_at(at)
            title = text[start:at]
            inner = _LABEL.search(title)
            opening = text[m.start() : at]
            if not title[1:-1].strip():  # an empty heading is none; one without a title is text
                if start == at:
                    top.parts.append(opening)
                continue
            outer = next((k for k in heads if _LEVEL[opened[k].marker] >= _LEVEL[marker]), None)
            close_to(outer if outer is not None else (heads[-1] if heads else 0) + 1)
            if marker == "subsubsection" and not counts.get("subsection"):
                marker = "subsection"
            node = open_node(marker, opening, star=bool(m.group("sstar")), title=_LABEL.sub("", title[1:-1]).strip())
            if inner:
                node.label = inner.group(1)
        elif kind == "item":
            if lists:
                held = len(opened)
                while not opened[held - 1].bits & _LIST:
                    held -= 1
                close_to(held)
                if text.startswith("[", at):
                    at = option_at(at)
                open_node("item", text[m.start() : at], option=text[m.end() : at])
            else:
                top.parts.append(m.group(0))
        elif kind == "verb":
            node = open_node("verb", m.group(0)[: m.group(0).index(m.group("vd")) + 1])
            node.parts.append(m.group("verb"))
            node.closing = m.group("vd")
            close_to(len(opened) - 1)
        elif kind == "dollar" or kind == "delim":
            sign = m.group(0) if kind == "dollar" else m.group("delim")
            close = _INLINE_CLOSE.get(sign)
            mark = "$" if sign in ("$", "(") else "equation"
            stop = find(close if sign[0] == "$" else "\\" + close, at) if close else -1
            body = text[at:stop] if stop >= 0 else ""
            if stop < 0 or mark == "$" and _BLANK_LINE.search(body):
                top.parts.append(m.group(0))
            else:
                if mark == "equation" and "&" in body:
                    mark = "align"
                node = open_node(mark, m.group(0), star=mark == "equation")
                if mark == "align":
                    open_row()
                    *lines, last = _ROW.split(body)
                    for line, closing in zip(lines[::2], lines[1::2], strict=True):
                        opened[-1].parts.append(line)
                        end_row(closing)
                        open_row()
                    opened[-1].parts.append(last)
                    end_row("")
                else:
                    node.parts.append(body)
                node.closing = close if sign[0] == "$" else "\\" + close
                at = stop + len(node.closing)
                close_to(len(opened) - 1)
        elif top.marker == "mathrow":
            end_row(m.group(0))
            open_row()
        else:
            top.parts.append(m.group(0))
    opened[-1].parts.append(text[at:])
    close_to(1)
    rows.append(opened[0].row(doc_id, count - 1))
    yield rows


_BLANK = re.compile(r"\s*")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in NODES.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py() or ""
            yield from closed_nodes(text if text.isascii() else text.translate(_ESCAPES), i)


def _peel(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = tuple(_SCHEMA.names)) -> Iterator[pa.RecordBatch]:
    """Nodes in batches of bounded size, of the columns that are asked for: neither a batch of many documents nor one large document is held as rows.

    Nodes leave no cycles behind, so nothing waits for the collector, which would walk all rows that are held again and again.
    """
    held: list[tuple] = []
    collects = gc.isenabled()
    gc.disable()
    try:
        for rows in _rows(batches):
            held += rows
            if len(held) >= CHUNK:
                yield _batch(held, names)
                held = []
        if held:
            yield _batch(held, names)
    finally:
        if collects:
            gc.enable()


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    fields = [_SCHEMA.field(n) for n in names]
    return pa.RecordBatch.from_arrays([pa.array(columns[_SCHEMA.get_field_index(f.name)], f.type) for f in fields], schema=pa.schema(fields))


def unescape(text: Column) -> Column:
    """A text with its own placeholder signs as they were; for whole texts, placeholders filled."""
    return F.when(text.contains(ESCAPE), apply_literals(text, [(ESCAPE + "a", OPEN), (ESCAPE + "b", CLOSE), (ESCAPE + "c", ESCAPE)])).otherwise(text)


def peel(docs: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) to nodes, with ``content_hash`` (kind and text) and ``node_id`` (place).

    A null text is an empty one. Texts that hold the placeholders' own signs have them
    escaped in the nodes; ``content.assemble`` restores them.

    ``only`` are the columns besides ``doc_id`` that are asked for, all by default: Spark does not tell a Python
    function what is read of its rows, and the others need not be made. The hashes are there where their columns are.
    """
    ship(docs.sparkSession)
    kinds = dict(x.split() for x in NODES.split(", "))
    names = ("doc_id", *only) if only else tuple(kinds)
    nodes = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _peel(batches, names), ", ".join(f"{n} {kinds[n]}" for n in names))
    if {"opening", "body", "closing", "marker"} <= set(names):
        nodes = nodes.withColumn("content_hash", F.sha1(F.concat("opening", "body", "closing", "marker")))
    return nodes.withColumn("node_id", F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))) if "pos" in names else nodes
