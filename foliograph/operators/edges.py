r"""Dependency edges of whole documents, found as their nodes close.

Nodes close after what they hold, so the references inside a node are the last ones that were found. A statement is a stretch of the
document's references, known by where it begins and ends in them: a document holds its references and labels, never pairs of them, and
nothing has to be dealt out after the parser.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ENVIRONMENTS, MULTILINE_MATH, VERBATIM
from ..functions.scanner import _plain_group
from ..session import ship
from . import peel
from .links import REF_RE
from .peel import CHUNK, CLOSE, OPEN

_REF = re.compile(REF_RE)
_CHILD = OPEN + CLOSE
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("target", pa.string())])


class _Node:
    """A node as far as edges ask for it: kind, label, texts that may hold references. A row is (pos, marker, label, references)."""

    __slots__ = ("pos", "marker", "bits", "closing", "star", "option", "title", "label", "parts", "children", "float")

    def __init__(self, pos: int, parent: _Node | None, marker: str, opening: str, star: bool = False, option: str = "", title: str = ""):
        self.pos, self.marker, self.star, self.option, self.title, self.label, self.parts, self.children = pos, marker, star, option, title, "", [], 0
        bits = self.bits = peel._BITS.get(marker, 0)
        if parent is None:
            self.float = None
            return
        parent.parts.append(_CHILD)
        self.float = self if bits & peel._FLOAT else parent.float if bits & peel._LAYS_OUT else None

    def row(self, doc_id: int, last: int) -> tuple | None:
        self.float = None  # no cycles are left behind
        text = "".join(self.parts)
        if self.option or self.title:
            text = f"{text} {self.option} {self.title}"
        refs = _REF.findall(text) if "ref{" in text else None
        return (self.pos, self.marker, self.label, refs) if refs or self.label else None


#: The parser's tokens, but ``\\verb``, as one group: a text is cut at all of them at once.
_CUT = re.compile(
    r"(\\(?:begin\{[A-Za-z]+\*?\}|end\{[A-Za-z]+\*?\}|item\b[ \t]*|label\{[^}]*\}|(?:chapter|section|subsection|subsubsection|worksheet|exercises|paragraphs)\*?\s*(?=\{)"
    r"|[\[\]()]|\\(?:\[[^\[\]&]*\])?|cr(?![A-Za-z])|\$)|\$\$?)"
)
_OPTION = _plain_group("[", "]")
_MATH = {"$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]"}
_INLINE = ("$", "\\(")
_TEXT = ("\\$", "\\)", "\\]", "\\cr")
#: Besides the parser's bits: a statement, and what only the parser reads; ``_TOLD`` are those of which something is done when they close.
_STATEMENT, _PARSED = 1 << 20, 1 << 21
_TOLD = _STATEMENT | peel._LIST | peel._FLOAT | peel._LAYS_OUT
#: Longer texts go through the parser, which does not hold their pieces; so do those in which so many open nodes are passed in vain.
LONGEST, PASSED = 1 << 20, 1 << 16
#: An open node of the quick reader is a list of these; ``_FIRST`` is how many references there were before it.
_MARKER, _BITS, _FIRST, _LABEL, _FLOAT = range(5)


@lru_cache(16)
def _bits(of: frozenset[str]) -> dict[str, int]:
    out = {m: peel._BITS.get(m, 0) | _STATEMENT for m in of}
    return peel._BITS | out | {m: _PARSED for m in (*MULTILINE_MATH, *VERBATIM, "mathrow")}


Found = tuple[list[str], set[str], dict[str, list[tuple[int, int]]]]


def _quick(text: str, of: frozenset[str]) -> Found | None:
    """As ``_parsed``, for texts of environments, items, labels and plain math; none for any other, which the parser reads.

    A subtree is a stretch of the text, so references are read piece by piece, in their order in the text. One that does not end in its piece is left to the parser.
    """
    if len(text) > LONGEST or "\\verb" in text:
        return None
    pieces = _CUT.split(text)
    bits_of, findall = _bits(of).get, _REF.findall
    targets: list[str] = []
    labels: set[str] = set()
    sources: dict[str, list[tuple[int, int]]] = {}
    lists = inside = passed = 0
    top: list = ["document", 0, 0, "", None]
    opened = [top]

    def close(node: list) -> None:
        nonlocal lists, inside
        _, bits, first, label, _ = node
        node[_FLOAT] = None  # no cycles are left behind
        if bits & peel._LIST:
            lists -= 1
        if bits & _STATEMENT:
            inside -= 1
            if label and len(targets) > first:
                if label in sources:
                    sources[label].append((first, len(targets)))
                else:
                    sources[label] = [(first, len(targets))]

    k, stop = 1, len(pieces)
    while k < stop:
        token, piece = pieces[k], pieces[k + 1]
        k += 2
        sign = token[1:2]
        if sign == "b" or sign == "i":
            if sign == "b":
                name = token[7:-2] if token[-2] == "*" else token[7:-1]
                bits = bits_of(name, 0)
                if bits & _PARSED:
                    return None
                takes = piece != "" and name != "equation" and (piece[0] == "[" or piece[0].isspace() and piece.lstrip()[:1] == "[")
            elif lists:
                name, bits = "item", 0
                while not top[_BITS] & peel._LIST:
                    opened.pop()
                    if top[_BITS] & _TOLD:
                        close(top)
                    top = opened[-1]
                takes = piece[:1] == "["
            else:  # ordinary text
                takes, name = False, ""
            if name:
                node = [name, bits, len(targets), "", None]
                if bits & _TOLD:
                    if bits & _STATEMENT:
                        inside += 1
                    if bits & peel._LIST:
                        lists += 1
                    if bits & peel._FLOAT:
                        node[_FLOAT] = node
                    elif bits & peel._LAYS_OUT:
                        node[_FLOAT] = top[_FLOAT]
                opened.append(node)
                top = node
            if takes:
                piece = piece.lstrip()
                m = _OPTION.match(piece)
                if m is None:  # one that holds more, or that is none
                    return None
                end = m.end()
                if inside and "ref{" in piece:
                    targets += findall(piece[1 : end - 1])
                piece = piece[end:]
        elif sign == "e" and token[2] == "n":
            name = token[5:-2] if token[-2] == "*" else token[5:-1]
            held = len(opened) - 1
            while held and opened[held][_MARKER] != name:
                held -= 1
            if held:
                while len(opened) > held:
                    top = opened.pop()
                    if top[_BITS] & _TOLD:
                        close(top)
                top = opened[-1]
            else:  # closes nothing: ordinary text
                passed += len(opened)
                if passed > PASSED:
                    return None
        elif sign == "l":
            if "ref{" in token:
                return None
            owner = top[_FLOAT] if top[_FLOAT] is not None and not top[_FLOAT][_LABEL] else top
            if not owner[_LABEL]:
                label = owner[_LABEL] = token[7:-1]
                if label:
                    labels.add(label)
        elif token in _MATH:
            if k >= stop or pieces[k] != _MATH[token] or (peel._BLANK_LINE.search(piece) if token in _INLINE else "&" in piece):
                return None
            if inside and "ref{" in piece:
                if piece.rfind("ref{") > piece.rfind("}"):
                    return None
                targets += findall(piece)
            piece = pieces[k + 1]
            k += 2
        elif sign == "\\":
            if "ref{" in piece or "ref{" in token:  # the backslash may stand before it
                return None
        elif token not in _TEXT:  # a heading
            return None
        if inside and "ref{" in piece:
            if piece.rfind("ref{") > piece.rfind("}"):
                return None
            targets += findall(piece)
    while len(opened) > 1:
        top = opened.pop()
        if top[_BITS] & _TOLD:
            close(top)
    return targets, labels, sources


def _parsed(text: str, of: frozenset[str]) -> Found:
    """References in the order in which their nodes close, labels, and by label the stretches of references inside its statements."""
    places: list[int] = []
    targets: list[str] = []
    names: dict[str, str] = {}
    labels: set[str] = set()
    sources: dict[str, list[tuple[int, int]]] = {}
    for rows in peel.closed_nodes(text, kind_of=_Node):
        for row in rows:
            if row is None:
                continue
            pos, marker, label, refs = row
            if refs:
                for t in refs:
                    places.append(pos)
                    targets.append(names.setdefault(t, t))
            if label:
                labels.add(label)
                if marker in of:
                    # Places before the statement are smaller, all others are inside it.
                    start = bisect_left(places, pos)
                    if start < len(places):
                        sources.setdefault(label, []).append((start, len(places)))
    return targets, labels, sources


def edges_of(text: str, of: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(source, target) labels of a text, each once: references anywhere inside labelled nodes of the markers ``of``, to labels that it has."""
    found = _quick(text, of)
    targets, labels, sources = _parsed(text, of) if found is None else found
    for source, stretches in sources.items():
        held = {t for start, end in stretches for t in targets[start:end]}
        for t in held & labels:
            yield source, t


def _batches(batches: Iterator[pa.RecordBatch], of: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Edges in batches of bounded size, however many documents a batch has or edges a document."""
    held: tuple[list, list, list] = ([], [], [])
    collects = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                for source, target in edges_of(text if text.isascii() else text.translate(peel._ESCAPES), of):
                    held[0].append(i)
                    held[1].append(source)
                    held[2].append(target)
                    if len(held[0]) >= CHUNK:
                        yield _batch(held)
                        held = ([], [], [])
        if held[0]:
            yield _batch(held)
    finally:
        if collects:
            gc.enable()


def _batch(held: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, _SCHEMA, strict=True)], schema=_SCHEMA)


def document_edges(docs: DataFrame, kinds: tuple[str, ...] = ("theorem", "definition")) -> DataFrame:
    """(doc_id, text), one row per document, to (doc_id, source, target): what ``links.dependency_edges`` makes of their nodes."""
    ship(docs.sparkSession)
    of = frozenset(m for c, _, _, names in ENVIRONMENTS if c in kinds for m in names.split())
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _batches(batches, of), "doc_id long, source string, target string")
