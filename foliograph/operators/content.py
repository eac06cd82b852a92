r"""Paragraphs, comments, tables, index, session cells, authors, math spans, assembly."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import env_catalog
from ..functions.text import title_key, to_ascii
from ..session import ship
from .peel import CLOSE, OPEN, PLACEHOLDER, unescape


def paragraphs(docs: DataFrame, separator: str = r"\n[ \t]*\n\s*") -> DataFrame:
    """(doc_id, ordinal, paragraph, content_hash); empty and trivial paragraphs are dropped before counting."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), separator, -1), lambda p: F.trim(p)), lambda p: ~p.isin("", "\\", "{", "}"))
    rows = docs.select("doc_id", F.posexplode(parts).alias("k", "paragraph"))
    return rows.select("doc_id", (F.col("k") + 1).alias("ordinal"), "paragraph", F.sha1(F.concat("paragraph", F.lit("text"))).alias("content_hash"))


#: Classes of nodes whose text is split into paragraphs.
CONTAINERS = ("section", "theorem", "definition", "example", "remark", "exercise", "proof", "aside", "hint", "item")
_END = re.compile(r"\n[ \t]*\n\s*")
_LINE_BREAK = re.compile(r"\\\\(?:\[[^\[\]]*\])?|\\linebreak(?![A-Za-z])")
_CHILD = re.compile(PLACEHOLDER)
_NONE = frozenset(("", "\\", "{", "}"))


def body_paragraphs(body: str, blocks: frozenset[int], breaks: bool = False) -> list[str]:
    """Paragraphs of a node's text: they end at blank lines and at children that are blocks; inline children are words."""
    cut, at = [], 0
    for m in _CHILD.finditer(body):
        if int(m.group(1)) in blocks:
            cut.append(body[at : m.start()])
            at = m.end()
    cut.append(body[at:])
    parts = [p for piece in cut for p in _END.split(_LINE_BREAK.sub("\n\n", piece) if breaks else piece)]
    return [p for p in (p.strip() for p in parts) if p not in _NONE]


def node_paragraphs(nodes: DataFrame, target: str = "html", kinds: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """(doc_id, pos, ordinal, paragraph): the paragraphs of documents, sections, statements and items.

    A child ends a paragraph if its kind is displayed as a block; math in a line, literal words and footnotes do not.
    In the structured target forced line breaks end paragraphs too.
    """
    ship(nodes.sparkSession)
    kind = F.broadcast(env_catalog(nodes.sparkSession).select("marker", "class", "display"))
    known = nodes.join(kind, "marker", "left") if "class" not in nodes.columns else nodes.join(kind.drop("class"), "marker", "left")
    inline = F.col("marker").isin("$", "verb") | F.coalesce(F.col("display").isin("mathinline", "FOOT"), F.lit(False))
    blocks = known.where(~inline & F.col("parent").isNotNull()).groupBy("doc_id", F.col("parent").alias("pos")).agg(F.collect_list(nodes["pos"]).alias("blocks"))

    @F.pandas_udf("array<string>")
    def split(body: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([body_paragraphs(t or "", frozenset() if k is None else frozenset(k.tolist()), target == "ptx") for t, k in zip(body, blocks, strict=True)])

    holders = known.where((F.col("marker") == "document") | F.col("class").isin(*kinds)).select("doc_id", "pos", F.regexp_replace("body", r"\\label\{[^}]*\}", "").alias("body"))
    rows = holders.join(blocks, ["doc_id", "pos"], "left").select("doc_id", "pos", F.posexplode(split("body", "blocks")).alias("k", "paragraph"))
    return rows.select("doc_id", "pos", (F.col("k") + 1).alias("ordinal"), "paragraph")


def inline_math(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, math): spans between single dollars without a blank line inside."""
    spans = F.filter(F.regexp_extract_all("text", F.lit(r"\$([^$]+)\$"), F.lit(1)), lambda m: ~m.rlike(r"\n[ \t]*\n"))
    return docs.select("doc_id", F.posexplode(spans).alias("k", "math")).select("doc_id", (F.col("k") + 1).alias("ordinal"), "math")


def document_parts(docs: DataFrame) -> DataFrame:
    """preamble, header, main, bibliography of each document."""
    t = F.col("text")
    body = F.coalesce(F.try_element_at(F.split(t, r"\\begin\{document\}", 2), F.lit(2)), t)
    header = F.regexp_extract(body, r"(?s)^(.*)\\maketitle", 1)
    rest = F.when(body.contains("\\maketitle"), F.regexp_extract(body, r"(?s)^.*\\maketitle(.*)$", 1)).otherwise(body)
    bib = F.regexp_extract(rest, r"(?s)(\\begin\{thebibliography\}.*\\end\{thebibliography\})", 1)
    main = F.regexp_replace(F.regexp_replace(rest, r"(?s)\\begin\{thebibliography\}.*\\end\{thebibliography\}", ""), r"(?s)\\end\{document\}.*$", "")
    has = t.rlike(r"\\begin\{document\}")
    return docs.select("doc_id", F.when(has, F.element_at(F.split(t, r"\\begin\{document\}", 2), 1)).otherwise("").alias("preamble"), header.alias("header"), main.alias("main"), bib.alias("bibliography"))


def table_cells(tables: DataFrame, text: str = "body") -> DataFrame:
    r"""(doc_id, row, col, cell, rule, lined): cells of tabular bodies.

    ``rule`` marks rows below an ``\hline``, ``lined`` cells below a ``\cline`` over their column.
    """
    rows = tables.select("doc_id", F.posexplode(F.filter(F.split(text, r"\\\\"), lambda r: r.rlike(r"\S"))).alias("row", "line"))
    clines = F.regexp_extract_all("line", F.lit(r"\\cline\{\s*([0-9]+\s*-\s*[0-9]+)\s*\}"), F.lit(1))
    ends = lambda c, k: F.trim(F.element_at(F.split(c, "-"), k)).cast("int")
    lined = F.flatten(F.transform(clines, lambda c: F.sequence(ends(c, 1), ends(c, 2))))
    line = F.regexp_replace(F.regexp_replace("line", r"\\hline|\\cline\{[^}]*\}", ""), r"^\s+|\s+$", "")
    rows = rows.select("doc_id", "row", F.col("line").contains("\\hline").alias("rule"), lined.alias("lined"), line.alias("line")).where("line <> ''")
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("doc_id").orderBy("row")))
    cells = rows.select("doc_id", "row", "rule", "lined", F.posexplode(F.split("line", "&")).alias("col", "cell"))
    return cells.withColumn("col", F.col("col") + 1).withColumn("cell", F.trim("cell")).withColumn("lined", F.array_contains("lined", F.col("col")))


def column_layout(spec: Column) -> Column:
    """Letters c, l, r, X of a column specification, rules and widths left out."""
    return F.filter(F.split(F.regexp_replace(spec, r"\{[^}]*\}|[^clrX]", ""), ""), lambda x: x != "")


def tables_html(tables: DataFrame, text: str = "body", spec: str = "spec") -> DataFrame:
    """(doc_id, html) of tabular bodies."""
    align = F.map_from_arrays(F.array(*[F.lit(x) for x in "clrX"]), F.array(*[F.lit(x) for x in ("center", "left", "right", "justify")]))
    cells = table_cells(tables, text).join(tables.select("doc_id", column_layout(F.col(spec)).alias("layout")), "doc_id")
    kind = F.coalesce(F.try_element_at(align, F.try_element_at("layout", F.col("col"))), F.lit("left"))
    cells = cells.withColumn("td", F.concat(F.lit('<td class="'), kind, F.when(F.col("lined"), " t2").otherwise(""), F.lit('">'), "cell", F.lit("</td>")))
    lines = cells.groupBy("doc_id", "row", "rule").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "td"))), lambda x: x["td"]), "").alias("tds"))
    lines = lines.withColumn("tr", F.concat(F.when(F.col("rule"), F.lit('<tr class="hline">')).otherwise(F.lit("<tr>")), "tds", F.lit("</tr>")))
    return lines.groupBy("doc_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "tr"))), lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))


def column_classes(spec: Column) -> Column:
    """Per column its letter and a ``v`` for each rule beside it; widths count as left-aligned, ``*{n}{x}`` as n columns."""
    plain = F.regexp_replace(F.regexp_replace(spec, r"p\{[^}]*\}", "l"), r"\s|@\{[^}]*\}", "")
    many = r"^\*\{([0-9]+)\}\{([a-zA-Z])\}$"
    plain = F.when(plain.rlike(many), _repeated(plain, many)).otherwise(plain)
    parts = F.regexp_extract_all(plain, F.lit("([clrX][^clrX]*)"), F.lit(1))
    named = F.transform(parts, lambda p: F.concat(F.substring(p, 1, 1), F.repeat(F.lit("v"), F.length(p) - 1)))
    return F.transform(named, lambda c, i: F.when((i == 0) & ~plain.rlike("^[clrX]"), F.concat(F.lit("v"), c)).otherwise(c))


def _repeated(spec: Column, pattern: str) -> Column:
    return F.repeat(F.regexp_extract(spec, pattern, 2), F.coalesce(F.regexp_extract(spec, pattern, 1).try_cast("int"), F.lit(0)))


def arrays(tables: DataFrame, target: str = "html", text: str = "body", spec: str = "spec") -> DataFrame:
    r"""(doc_id, markup): tabular bodies as rows and cells of a target, with rules of rows and columns.

    An ``\hline`` is a row of its own above the row it stands before, two of them a thick one;
    cells below a ``\cline`` and columns with rules have them in their class. Rows without text are dropped.
    """
    row_tag, cell_tag = {"html": ("tr", "td"), "ptx": ("row", "cell")}[target]
    body = F.regexp_replace(F.col(text), r"\\tabularnewline", r"\\\\")
    rows = tables.select("doc_id", column_classes(F.col(spec)).alias("layout"), F.posexplode(F.filter(F.split(body, r"\\\\|\\cr\b"), lambda r: r.rlike(r"\S"))).alias("row", "line"))
    rules = F.size(F.regexp_extract_all("line", F.lit(r"(\\hline)"), F.lit(1)))
    clines = F.regexp_extract_all("line", F.lit(r"\\cline\{\s*([0-9]+\s*-\s*[0-9]+)\s*\}"), F.lit(1))
    ends = lambda c, k: F.trim(F.element_at(F.split(c, "-"), k)).cast("int")
    rows = rows.withColumns({"rules": rules, "lined": F.flatten(F.transform(clines, lambda c: F.sequence(ends(c, 1), ends(c, 2)))), "rest": F.trim(F.regexp_replace("line", r"\\hline|\\cline\{[^}]*\}", ""))})
    shown = lambda c, i: F.concat(F.coalesce(F.get("layout", i), F.lit("unknown")), F.when(F.array_contains("lined", (i + 1).cast("int")), " t2").otherwise(""))
    opening = (lambda c, i: F.concat(F.lit(f'<{cell_tag} class="'), shown(c, i), F.lit('">'))) if target == "html" else (lambda c, i: F.lit(f"<{cell_tag}>"))
    cells = F.transform(F.split("rest", "&"), lambda c, i: F.concat(opening(c, i), F.trim(c), F.lit(f"</{cell_tag}>")))
    own = F.when(F.col("rest") != "", F.concat(F.lit(f"<{row_tag}>"), F.array_join(cells, ""), F.lit(f"</{row_tag}>\n"))).otherwise("")
    n = F.size("layout")
    if target == "html":
        rule = F.concat(F.lit("<tr><td class='hline"), F.when(F.col("rules") > 1, "thick").otherwise(""), F.lit("' colspan='"), n.cast("string"), F.lit("'><hr/></td></tr>\n"))
    else:
        rule = F.concat(F.lit('<row bottom="'), F.when(F.col("rules") > 1, "medium").otherwise("minor"), F.lit('">'), F.repeat(F.lit("<cell></cell>"), n), F.lit("</row>\n"))
    line = F.concat(F.when(F.col("rules") > 0, rule).otherwise(""), own)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", line.alias("t")))), lambda x: x["t"]), "").alias("markup"))


def build_index(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sorted index lines: letter, main entry, sub-entry; adjacent equal entries become one.

    ``sort@shown`` sorts by what stands before the sign and shows what follows it;
    ``main!sub`` has two levels.
    """
    sort = F.upper(F.element_at(F.split("entry", "@"), 1))
    shown = F.element_at(F.split("entry", "@"), -1)
    e = entries.select(key, sort.alias("sort"), shown.alias("shown"), "entry").distinct()
    main, sub = F.element_at(F.split("shown", "!"), 1), F.try_element_at(F.split("shown", "!"), F.lit(2))
    w = W.partitionBy(key).orderBy("sort", "entry")
    e = e.select(key, "sort", "entry", F.substring("sort", 1, 1).alias("letter"), main.alias("main"), sub.alias("sub"))
    return e.withColumn("place", F.row_number().over(w)).withColumn("new_letter", F.coalesce(F.lag("letter").over(w) != F.col("letter"), F.lit(True))).withColumn("new_main", F.coalesce(F.lag("main").over(w) != F.col("main"), F.lit(True))).drop("sort", "entry")


def session_cells(lines: DataFrame, prompt: Column, order: str = "ordinal") -> DataFrame:
    """Runs of prompt and answer lines as cells: (doc_id, cell, is_input, text)."""
    w = W.partitionBy("doc_id").orderBy(order)
    marked = lines.withColumn("is_input", prompt)  # replaces a column of that name
    marked = marked.withColumn("cell", F.sum(F.when(F.coalesce(F.lag("is_input").over(w) != F.col("is_input"), F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy("doc_id", "cell", "is_input").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("text"))


# Prompts of sessions.
PROMPT = r"^\s*(?:sage:|\.\.\.\.:)"


def session_lines(docs: DataFrame) -> DataFrame:
    r"""(doc_id, ordinal, line, is_input): lines of sessions without their prompts.

    A line is input if it has a prompt, or if the line before it is input that ends in a backslash.
    """
    doc = W.partitionBy("doc_id").orderBy("ordinal")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "raw")).withColumn("prompt", F.col("raw").rlike(PROMPT))
    rows = rows.withColumn("goes_on", ~F.col("prompt") & F.coalesce(F.lag("raw").over(doc).endswith("\\"), F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(doc.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = F.first("prompt").over(W.partitionBy("doc_id", "run").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow))
    bare = F.regexp_replace(F.regexp_replace("raw", r"^\s*sage:\s?", ""), r"^\s*\.\.\.\.:\s?", "    ")
    return rows.select("doc_id", "ordinal", F.when(F.col("prompt"), bare).otherwise(F.col("raw")).alias("line"), first.alias("is_input"))


def session_markup(docs: DataFrame) -> DataFrame:
    """(doc_id, markup): sessions as cells of input and output; a text without a prompt is preformatted."""
    has = F.coalesce(F.col("text").contains("sage:"), F.lit(False))
    cells = session_cells(session_lines(docs.where(has)), F.col("is_input"))
    w = W.partitionBy("doc_id").orderBy("cell")
    answered = F.lead("is_input").over(w).isNotNull()
    inside = F.concat(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n"))
    piece = F.when(F.col("is_input"), F.concat(F.lit("\n<sage><input>"), inside, F.lit("</input>"), F.when(answered, "").otherwise("</sage>"), F.lit("\n"))).otherwise(F.concat(F.lit("\n<output>"), inside, F.lit("</output></sage>\n")))
    # An answer before any prompt stands alone.
    piece = F.when(~F.col("is_input") & (F.col("cell") == 1), F.concat(F.lit("\n<pre>"), inside, F.lit("</pre>\n"))).otherwise(piece)
    made = cells.withColumn("piece", piece).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "piece"))), lambda x: x["piece"]), "").alias("markup"))
    plain = docs.where(~has).select("doc_id", F.concat(F.lit("<pre>"), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("</pre>")).alias("markup"))
    return made.unionByName(plain)


def suffix_pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Rows whose names ``a`` and ``b`` end one like the other, joined by equality of a whole name with an ending of the other."""
    endings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.col(c).substr(i, F.length(c)))).alias("__end")
    one = left.withColumn("__end", F.col(a)).join(right.select("*", endings(b)), [*on, "__end"])
    two = left.select("*", endings(a)).join(right.withColumn("__end", F.col(b)), [*on, "__end"])
    return one.drop("__end").unionByName(two.drop("__end")).distinct()


def author_matches(names: DataFrame, people: DataFrame) -> DataFrame:
    """Names with the one person whose last name ends like theirs and whose first initial is equal.

    ``names(name)`` and ``people(person_id, firstname, lastname)``. Candidates come from joins
    on the initial and a whole last name, of either side, that is an ending of the other.
    """
    ascii_name = to_ascii(F.col("name"))
    n = names.select("name", F.substring(ascii_name, 1, 1).alias("initial"), F.element_at(F.split(ascii_name, r"\s+"), -1).alias("last"))
    p = people.select("person_id", F.substring(to_ascii(F.col("firstname")), 1, 1).alias("initial"), to_ascii(F.col("lastname")).alias("pl")).where("pl <> ''")
    both = suffix_pairs(n, p, ["initial"], "last", "pl")
    return both.groupBy("name").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").select("name", "person_id")


def title_pairs(titles: DataFrame) -> DataFrame:
    """(key, n, first_id) of titles (id, title) that are equal under the reduced form."""
    return titles.select("id", title_key(F.col("title")).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def wrap(nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """Nodes with ``open_tag`` and ``close_tag`` of their class from a fixed template table (class, tag)."""
    joined = nodes.join(F.broadcast(templates), "class", "left")
    tag = F.coalesce("tag", F.lit("div"))
    ident = F.concat(F.lit(' id="'), F.col("out_id"), F.lit('"'))
    return joined.withColumn("open_tag", F.concat(F.lit("<"), tag, ident, F.lit(">"))).withColumn("close_tag", F.concat(F.lit("</"), tag, F.lit(">"))).drop("tag")


_CUT = re.compile(PLACEHOLDER)


def fill(rows: Iterable[tuple[int, str, str, str]]) -> str:
    """The text of a tree from its (pos, before, body, after), each child at its placeholder; the first node is the root."""
    leaves: dict[int, str] = {}
    inner: dict[int, tuple[str, str, str]] = {}
    for pos, before, body, after in rows:
        if body and OPEN in body:
            inner[pos] = (before or "", body, after or "")
        else:
            leaves[pos] = (before or "") + (body or "") + (after or "")

    def pieces(pos: int) -> Iterator[str | int]:
        """The texts of a node in order, with the positions of children that hold others."""
        before, body, after = inner[pos]
        cut = _CUT.split(body)
        yield before + cut[0]
        for child, gap in zip(cut[1::2], cut[2::2], strict=True):
            at = int(child)
            text = leaves.get(at)
            yield at if text is None else text
            if gap:
                yield gap
        yield after

    root = min(min(held) for held in (leaves, inner) if held)
    if root in leaves:
        return leaves[root]
    out, opened = [], [pieces(root)]
    while opened:
        for piece in opened[-1]:
            if type(piece) is int:
                opened.append(pieces(piece))
                break
            out.append(piece)
        else:
            opened.pop()
    return "".join(out)


#: Nodes that become Python values together, unless one tree has more.
TOGETHER = 4096


def filled_trees(nodes: pa.ListArray) -> Iterator[str | None]:
    """Some trees at a time become Python values, not all of a batch."""
    ends, valid, k = nodes.offsets.to_pylist(), nodes.is_valid().to_pylist(), 0
    while k < len(nodes):
        first, start = k, ends[k]
        while k < len(nodes) and (k == first or ends[k + 1] - start <= TOGETHER):
            k += 1
        some = nodes.values.slice(start, ends[k] - start)
        rows = list(zip(*(some.field(name).to_pylist() for name in ("pos", "before", "body", "after")), strict=True))
        for j in range(first, k):
            yield fill(rows[ends[j] - start : ends[j + 1] - start]) if valid[j] else None


@F.arrow_udf(T.StringType())
def _fill(nodes: pa.Array) -> pa.Array:
    return pa.array(filled_trees(nodes), pa.string())


#: Characters of finished texts that leave a task together, unless one text has more.
LEAVING = 1 << 22


def assembled(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, pos, before, body, after, carried) in order of keys and pos to a row (keys, carried, text) for each tree.

    One tree is held at a time, its leaves as finished texts; ``carried`` are those of its first row.
    """
    fields: list[pa.Field] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            if not fields:
                fields.extend(batch.schema)
            columns = [c.to_pylist() for c in batch.columns]
            yield from zip(zip(*columns[:keys], strict=True), *columns[keys:], strict=True)

    def batch() -> pa.RecordBatch:
        named = [*fields[:keys], *fields[keys + 4 :], pa.field("text", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), named, strict=True)], names=[f.name for f in named])

    done, size = [], 0
    for key, tree in groupby(rows(), itemgetter(0)):
        first = next(tree)
        text = fill(row[1:5] for row in chain((first,), tree))
        done.append((*key, *first[5:], text))
        size += len(text)
        if size >= LEAVING or len(done) >= TOGETHER:
            yield batch()
            done, size = [], 0
    if done:
        yield batch()


def assemble(nodes: DataFrame, before: str = "opening", after: str = "closing", by: tuple[str, ...] = ("doc_id",), also: tuple[Column, ...] = (), carried: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, text): placeholders filled from the root down, a document at a time, or a part of one by further keys.

    One exchange brings a tree's nodes together in order, however deep it is; they pass as rows, so that no value but
    its text holds a tree. Texts are never used as patterns. Rows of other documents are not touched.

    ``carried`` are columns of a tree's first node. ``also`` are further aggregates over the same nodes, so that what
    else is asked of them needs no second parse; with them the nodes of a tree are gathered as one value, for documents
    that are small.
    """
    ship(nodes.sparkSession)
    cells = ("pos", F.col(before).alias("before"), "body", F.col(after).alias("after"))
    if also:
        return nodes.groupBy(*by).agg(unescape(_fill(F.collect_list(F.struct(*cells)))).alias("text"), *also)
    rows = nodes.select(*by, *cells, *carried).repartition(*by).sortWithinPartitions(*by, "pos")
    keys = len(by)
    schema = T.StructType([*rows.schema[:keys], *rows.schema[keys + 4 :], T.StructField("text", T.StringType())])
    return rows.mapInArrow(lambda batches: assembled(batches, keys), schema).withColumn("text", unescape(F.col("text")))


def edges(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_pos, ordinal, child_pos) read back from the placeholders."""
    found = F.posexplode(F.regexp_extract_all("body", F.lit(f"{OPEN}([0-9]+){CLOSE}"), F.lit(1))).alias("k", "child")
    return nodes.select("doc_id", F.col("pos").alias("parent_pos"), found).select("doc_id", "parent_pos", (F.col("k") + 1).alias("ordinal"), F.col("child").cast("int").alias("child_pos"))
