"""Quality rules with cross-document line frequency.

One pass measures every text and hashes its normalised lines (lower-cased words, white
space folded). Distinct documents per host and line are counted; a line of more than
``MIN_DOCS`` documents, however large the host, is removed from all of the host's
documents, and a document of which too few words are left is rejected. ``RULES_SQL`` has
``max(MIN_DOCS, SHARE * documents of the host)``, for which the query asks by ``share``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize
from .secrets import redact

MIN_WORDS = 50
#: Rejected by rule: more than this share of words in repeated 3-word windows, in per cent.
MAX_REPEAT = 50
REPEAT_WINDOW = 3
MIN_DOCS = 20
SHARE = 0.02
#: Rejected as depleted: less than this share of the words left.
LEFT_SHARE = 0.3
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that tell rows apart as well."""
    return K.mix(keys + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def measure(data: np.ndarray, offsets: np.ndarray, normalised: bool = True) -> dict[str, np.ndarray]:
    """The base measures of each text and, if asked for, (row, normalised hash, words, places) of its lines."""
    n = len(offsets) - 1
    starts, ends = K.find_words(data, offsets, K.NOT_SPACE)
    first = np.searchsorted(starts, offsets)
    word_row = K.segment_rows(first)
    exact = K.word_hashes(data, starts, ends, lower=False)
    counts = K.byte_counts(data, offsets)
    # A code point of a word is a byte that is no white space and continues none.
    out = {"n_words": np.diff(first), "word_chars": counts[:, K.NOT_SPACE & ((np.arange(256) & 0xC0) != 0x80)].sum(axis=1), "n_symbols": counts[:, _SYMBOL].sum(axis=1), "bytes": counts}
    # Windows found again in the text.
    w = K.shingles(exact, REPEAT_WINDOW)
    inside = word_row[: len(w)] == word_row[REPEAT_WINDOW - 1 :] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = _per_row(w[at], word_row[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(starts) + REPEAT_WINDOW, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(word_row[np.cumsum(cover)[: len(starts)] > 0], minlength=n)
    # Lines: cut at each \n and each text's start.
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    row = np.searchsorted(offsets, cut, "right") - 1
    lo, hi = np.searchsorted(starts, cut), np.searchsorted(starts, stop)
    own = hi > lo
    cut, stop, row, lo, hi = cut[own], stop[own], row[own], lo[own], hi[own]
    stop = stop - (data[stop - 1] == 10)
    raw = _per_row(K.word_hashes(data, cut, stop, lower=False), row) if len(cut) else np.zeros(0, np.uint64)
    kept = K.first_of_each(raw)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[kept], minlength=n)
    out |= {"starts": starts, "ends": ends, "first": first, "word_row": word_row}
    if not normalised:
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    line = K.range_hashes(K.word_hashes(data, starts, ends), lo, hi)
    key, kept, which = np.unique(_per_row(line, row), return_index=True, return_inverse=True)
    words = np.bincount(which, hi - lo, minlength=len(key)).astype(np.int64)
    order = np.argsort(row[kept], kind="stable")
    # Where each line stands, in code points of its text with the newline that ends it, line by line.
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key))
    place = rank[which.ravel()] if len(key) else np.zeros(0, np.int64)
    by_line = np.argsort(place, kind="stable")
    past = np.minimum(stop + 1, offsets[row + 1])
    out["line_places"] = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(key)))])
    out["line_start"], out["line_end"] = ((points[x] - points[offsets[row]])[by_line] for x in (cut, past))
    out["line_row"], out["line"], out["line_words"] = row[kept][order], line[kept][order], words[order]
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column(batch.num_columns - 1))
        for a, b in K.row_chunks(offsets):
            base = offsets[a]
            m = measure(data[base : offsets[b]], offsets[a : b + 1] - base)
            at = pa.array(np.searchsorted(m["line_row"], np.arange(b - a + 1)), pa.int32())
            places = pa.StructArray.from_arrays([pa.array(m["line_start"], pa.int32()), pa.array(m["line_end"], pa.int32())], ["start", "end"])
            places = pa.ListArray.from_arrays(pa.array(m["line_places"], pa.int32()), places)
            lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(m["line"].view(np.int64)), pa.array(m["line_words"]), places)]
            kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(m[k]) for k in MEASURES], *lists], [*batch.schema.names[:-1], *MEASURES, "lines", "line_words", "line_places"])


def apply_rules(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), min_docs: int = MIN_DOCS, share: float = 0.0, left_share: float = LEFT_SHARE, carry_text: bool = False) -> DataFrame:
    """The ``keep`` columns, the measures, ``base_failed``, ``removed_words``, ``kept`` and ``removed``.

    ``removed`` has the spans of the removed lines in code points, end exclusive, each with
    its newline. If asked for, ``text`` is the text without them.

    A line of more than ``max(min_docs, share * documents of the host)`` documents goes. With
    a share the limit rises with the host and spares what thousands of its documents have.
    A null text has no words and fails the base rule. The null host is a host of its own.
    Rows are documents: repeated rows and ids count as often as they occur. An empty
    table gives an empty result; columns that are not named are ignored. Very long
    texts are measured whole.
    """
    slim = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.xxhash64(host).alias("host"), F.monotonically_increasing_id().alias("row_id"), *([F.col("text").alias("whole")] if carry_text else []), "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    numbers = ", ".join(f"{k} long" for k in MEASURES)
    rows = materialize(slim.mapInArrow(_measured, f"{fields}, {numbers}, lines array<long>, line_words array<long>, line_places array<array<struct<start:int,end:int>>>"), "rules-measures")
    limits = rows.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * share).alias("most"))
    limits = materialize(limits, "rules-hosts")
    lines = rows.select("row_id", "host", F.explode(F.arrays_zip("lines", "line_words", "line_places")).alias("l"))
    lines = lines.select("row_id", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"), F.col("l.line_places").alias("places"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).join(limits, "host").where(F.col("n") > F.col("most"))
    common = materialize(common.select("host", "line"), "rules-lines")
    removed = lines.join(common, ["host", "line"]).groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.sort_array(F.flatten(F.collect_list("places"))).alias("removed"))
    out = rows.drop("lines", "line_words", "line_places").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < left_share * F.col("n_words")
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, failed.alias("base_failed"), "removed_words", (~failed & ~depleted).alias("kept"), "removed", *([redact(F.col("whole"), F.col("removed"), "").alias("text")] if carry_text else []))


def rules_digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from the operator's result."""
    return found.select("doc_id", *MEASURES, "base_failed", "removed_words", "kept")


RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
t AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t) WHERE c > 1) GROUP BY r),
l AS (SELECT r, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
own AS (SELECT * FROM l WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM own GROUP BY r),
norm AS (SELECT r, source, array_to_string(lw, ' ') AS line, sum(len(lw)) AS words FROM own JOIN d USING (r) GROUP BY ALL),
host AS (SELECT source, greatest({MIN_DOCS}::DOUBLE, count(*) * {SHARE}::DOUBLE) AS most FROM d GROUP BY source),
com AS (SELECT n.source, line FROM norm n JOIN host h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, line, most HAVING count(*) > most),
rem AS (SELECT r, sum(words) AS n FROM norm n JOIN com c ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rem USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND NOT (n_words - removed_words < {LEFT_SHARE}::DOUBLE * n_words) AS kept FROM m
"""
