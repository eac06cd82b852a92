r"""Bibliographies in four notations as one table: ``\bibitem``, ``.bib`` files, amsrefs' ``\bib`` and AMS-TeX's ``\ref ... \endref``.

A reader of records with nested braces, brackets and quotes yields (key, field, value) rows; what an entry shows is put
together from them in a second step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scanner import Groups, group_at, group_ends
from ..session import ship

FIELDS = "ordinal int, notation string, kind string, key string, label string, place int, field string, value string"
_NAME = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")
_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_ITEM = re.compile(r"\\bibitem(?![A-Za-z])|\\end\{thebibliography\}")
_BIB = re.compile(r"\\bib(\*?)(?=\s*\{)")
_REF = re.compile(r"\\(ref|endref)(?![A-Za-z])")
_PLAIN_FIELD = re.compile(r"\\([A-Za-z]+)(?![A-Za-z])")
_BARE = re.compile(r"[^,})\s#]+")

# Fields of AMS-TeX records and the names that other notations give them; months.
AMS_FIELDS = {
    "by": "author", "paper": "title", "book": "title", "jour": "journal", "vol": "volume", "yr": "year", "pages": "pages", "page": "pages", "publ": "publisher",
    "publaddr": "address", "issue": "number", "ed": "editor", "eds": "editor", "inbook": "booktitle", "bookinfo": "series", "paperinfo": "note", "finalinfo": "note", "no": "no", "key": "key", "toappear": "note", "moreref": "note",
}
#: Names of .bib and amsrefs fields that mean the same.
SAME_FIELDS = {"date": "year", "place": "address", "eprint": "arxiv", "editors": "editor"}


def _pieces(text: str, at: int, last: int, strings: dict[str, str]) -> tuple[str, int]:
    """A value of a field: braced, quoted or bare pieces joined by #, and where it ends, before ``last``."""
    out = []
    while True:
        at = re.compile(r"\s*").match(text, at).end()
        start, end = group_at(text, at)
        if start < end:
            out.append(text[start + 1 : end - 1])
            at = end
        elif text.startswith('"', at):
            # A quote inside braces does not end the value.
            ends, stop = group_ends(text), at + 1
            while stop < last and text[stop] != '"':
                stop = ends.get(stop, stop + (2 if text[stop] == "\\" else 1))
            out.append(text[at + 1 : min(stop, last)])
            at = min(stop + 1, last)
        elif m := _BARE.match(text, at):
            out.append(strings.get(m.group(0).lower(), m.group(0)))
            at = m.end()
        at = re.compile(r"\s*").match(text, at).end()
        if not text.startswith("#", at):
            return " ".join("".join(out).split()), at
        at += 1


def _fields(text: str, at: int, stop: int, strings: dict[str, str]) -> Iterator[tuple[str, str]]:
    while (m := _NAME.match(text, at)) and m.end() < stop:
        value, at = _pieces(text, m.end(), stop, strings)
        name = m.group(1).lower()
        yield SAME_FIELDS.get(name, name), value
        comma = text.find(",", at, stop)
        if comma < 0:
            return
        at = comma + 1


def bib_files(text: str) -> Iterator[tuple[str, str, str, list[tuple[str, str]]]]:
    """(kind, key, label, fields) of the entries of a ``.bib`` file; strings are put in, comments and preambles left out."""
    strings, at = {}, 0
    while (m := _ENTRY.search(text, at)) is not None:
        sign = m.group(2)
        start, end = group_at(text, m.end() - 1, sign, "}" if sign == "{" else ")")
        at = max(end, m.end())
        if start == end:  # never closed: no entry
            continue
        kind, stop = m.group(1).lower(), end - 1
        if kind == "string":
            strings |= {k: v for k, v in _fields(text, m.end(), stop, strings)}
        elif kind not in ("comment", "preamble"):
            comma = text.find(",", m.end(), stop)
            key = text[m.end() : stop if comma < 0 else comma].strip()
            if key and not any(c in key for c in '{}="'):
                yield kind, key, "", list(_fields(text, comma + 1, stop, strings)) if comma >= 0 else []


def amsrefs(text: str) -> Iterator[tuple[str, str, str, list[tuple[str, str]]]]:
    r"""(kind, key, label, fields) of ``\bib{key}{kind}{fields}``; a repeated field is one with all values."""
    for m in _BIB.finditer(text):
        groups, at = [], m.end()
        for _ in range(3):
            start, end = group_at(text, at)
            if start == end:
                break
            groups.append((start + 1, end - 1))
            at = end
        if len(groups) == 3:
            (a, b), (c, d), (e, f) = groups
            yield text[c:d].strip().lower(), text[a:b].strip(), "", list(_fields(text, e, f, {}))


def _bare(value: str) -> str:
    """A value without braces that hold all of it."""
    return value[1:-1] if value.startswith("{") and group_ends(value).get(0) == len(value) else value


def ams_records(text: str) -> Iterator[tuple[str, str, str, list[tuple[str, str]]]]:
    r"""(kind, key, label, fields) of ``\ref ... \endref``; the key is the record's ``\key`` or ``\no``."""
    opened = None
    for m in _REF.finditer(text):
        if m.group(1) == "ref":
            opened = m.end()
        elif opened is not None:
            record, opened = text[opened : m.start()], None
            ends = group_ends(record)
            marks, at = [], 0
            while (x := _PLAIN_FIELD.search(record, at)) is not None:
                inside = record.find("{", at, x.start())
                if inside >= 0 and inside in ends:  # what braces hold is a value
                    at = ends[inside]
                    continue
                at = x.end()
                if x.group(1) in AMS_FIELDS:
                    marks.append((x.group(1), x.start(), x.end()))
            found = [(AMS_FIELDS[n], _bare(" ".join(record[e : marks[k + 1][1] if k + 1 < len(marks) else len(record)].split()).rstrip(" ,"))) for k, (n, _, e) in enumerate(marks)]
            names = dict(found)
            key = names.get("key") or names.get("no") or ""
            if found:
                yield "book" if any(n == "book" for n, *_ in marks) else "article", key, key, [(n, v) for n, v in found if n not in ("key", "no")]


def bib_items(text: str) -> Iterator[tuple[str, str, str, list[tuple[str, str]]]]:
    r"""(kind, key, label, fields) of ``\bibitem[label]{key} text`` up to the next item or the list's end; the text is one field."""
    marks = [m for m in _ITEM.finditer(text)]
    braces, brackets = Groups(text), Groups(text, "[", "]")
    for k, m in enumerate(marks):
        if m.group(0) != "\\bibitem":
            continue
        at, label = m.end(), ""
        start, end = brackets.group_at(at)
        if start < end:
            label, at = text[start + 1 : end - 1], end
        start, end = braces.group_at(at)
        if start == end:
            continue
        stop = marks[k + 1].start() if k + 1 < len(marks) else len(text)
        yield "item", text[start + 1 : end - 1].strip(), label, [("raw", text[end:stop].strip())]


READERS = {"items": bib_items, "bib": bib_files, "amsrefs": amsrefs, "records": ams_records}


def read_records(text: str) -> list[tuple[int, str, str, str, str, int, str, str]]:
    """(ordinal, notation, kind, key, label, place, field, value) of all entries of a text, whichever notations it has; entries count by notation."""
    out = []
    for notation, reader in READERS.items():
        for k, (kind, key, label, fields) in enumerate(reader(text), 1):
            out += [(k, notation, kind, key, label, place, name, value) for place, (name, value) in enumerate(fields or [("raw", "")], 1)]
    return out


@F.udtf(returnType=FIELDS)
class BibRecords:
    """The entries of a text as rows of fields."""

    def eval(self, text: str):
        yield from read_records(text or "")


def record_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, notation, kind, key, label, place, field, value) of the entries of (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").lateralJoin(BibRecords(F.col("text").outer())).drop("text")


#: Entries that are handed on together, however large or small the documents are.
CHUNK = 8192


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of documents (doc_id, text), in batches of bounded size."""
    names = ("doc", "ordinal", "key", "label", "raw")
    for batch in batches:
        ids, rows = batch.column(0), []

        def entries_of(rows: list[tuple], ids: pa.Array = ids) -> pa.RecordBatch:
            of, *columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names)

        for i, text in enumerate(batch.column(1)):
            for k, (_, key, label, ((_, raw),)) in enumerate(bib_items(text.as_py() or ""), 1):
                rows.append((i, k, key, label or str(k), raw))
                if len(rows) >= CHUNK:
                    yield entries_of(rows)
                    rows = []
        if rows:
            yield entries_of(rows)


def items(docs: DataFrame) -> DataFrame:
    r"""(doc_id, ordinal, key, label, raw) of the ``\bibitem`` entries of (doc_id, text), as ``entries`` gives them.

    An item is one field, so nothing is put together: rows come from the reader as they are, without an exchange.
    """
    ship(docs.sparkSession)
    doc = T.StructField("doc", docs.schema["doc_id"].dataType)
    kind = T.StructType([doc, T.StructField("ordinal", T.IntegerType()), *(T.StructField(name, T.StringType()) for name in ("key", "label", "raw"))])
    return docs.select(F.col("doc_id").alias("doc"), "text").mapInArrow(_items, kind).withColumnRenamed("doc", "doc_id")


def entries(fields: DataFrame) -> DataFrame:
    """(doc_id, ordinal, notation, kind, key, label, raw): one row per entry, with what it shows.

    Authors, title, source, place in it and year, as far as there are any. Without a label the ordinal stands. A field
    that occurs several times, as authors do, is one with all of its values.
    """
    numbered = fields.groupBy("doc_id", "notation", "ordinal", "kind", "key", "label", "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), " and ").alias("value"))
    whole = numbered.groupBy("doc_id", "notation", "ordinal", "kind", "key", "label").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("f"))
    field = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("f", F.lit(n)), F.lit("")) for n in names])
    volume = F.when(field("volume").isNotNull(), F.concat(F.lit("\\textbf{"), field("volume"), F.lit("}")))
    year = F.when(field("year").isNotNull(), F.concat(F.lit("("), F.regexp_extract(field("year"), "^([0-9]*)", 1), F.lit(")")))
    source = F.nullif(F.concat_ws(" ", field("journal", "booktitle", "publisher", "institution", "school"), volume, year), F.lit(""))
    title = F.when(field("title").isNotNull(), F.concat(F.lit("\\textit{"), field("title"), F.lit("}")))
    arxiv = F.when(field("arxiv").isNotNull(), F.concat(F.lit("arXiv:"), field("arxiv")))
    shown = F.concat(F.concat_ws(", ", F.replace(field("author", "editor"), F.lit(" and "), F.lit(", ")), title, source, field("pages"), arxiv, field("note")), F.lit("."))
    label = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("ordinal").cast("string"))
    return whole.select("doc_id", "ordinal", "notation", "kind", "key", label.alias("label"), F.coalesce(F.try_element_at("f", F.lit("raw")), shown).alias("raw"))
