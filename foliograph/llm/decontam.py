"""Benchmark decontamination by a prefix-filtered set join.

A window of benchmark words is a set of shingles (three consecutive words, fewer in
shorter items). A document holds the window only if it holds all of its shingles, so one
shingle, the *prefix*, is necessary: the rarest one by its count over the whole corpus.
A first pass counts the benchmark's shingles in all documents. A second one joins the
documents' shingles with the prefixes, applies the bounds that position and length set
(the prefix's offset fixes where the window would start and end inside the document) and
compares the hash of the whole window and then the bytes of all its words.

The benchmark side is read in blocks of bounded size and each block is broadcast, about
eight bytes for each byte of its text; the documents stream past each block and are never
shuffled. One block is the usual case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 10
SHINGLE = 3
#: Benchmark text broadcast at once.
BLOCK_BYTES = 8 << 20

#: Bytes of words as they are compared: A-Z lower-cased, everything else that is no word a blank.
_PLAIN = bytes(int(x) if K.ALNUM[x] else 32 for x in K.lower_table())


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of items in blocks; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def index_items(ids: list, texts: list, window: int = WINDOW, q: int = SHINGLE) -> dict:
    """Distinct windows of a block of items: where they stand among its words, their hashes and lengths, and the items that have them."""
    data, offsets = K.utf8(pa.array(texts, pa.large_string()))
    starts, ends, words, first = K.doc_words(data, offsets, K.ALNUM)
    count = np.diff(first)
    length = np.minimum(count, window)
    n = np.where(count > 0, count - length + 1, 0)
    item = np.repeat(np.arange(len(ids)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][item]
    size = length[item]
    key = np.zeros(len(start), np.uint64)
    for w in np.unique(size):
        own = size == w
        key[own] = K.shingles(words, int(w))[start[own]]
    order = np.lexsort((size, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (size[order][1:] != size[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    kept = order[new]
    pairs = np.unique(np.column_stack([which, item]), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    at, size = start[kept], size[kept]
    index = {"at": at, "size": size, "key": key[kept], "q": np.minimum(size, q), "words": words, "window": pairs[:, 0], "item": pairs[:, 1].astype(np.int32)}
    index |= {"data": data.tobytes().translate(_PLAIN), "starts": starts.astype(np.int32), "ends": ends.astype(np.int32)}
    index["shingles"] = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in _offsets(index))]))
    return index


def _offsets(index: dict) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """(windows, offset, hash of the shingle there, its words) for every offset of a shingle in a window."""
    for q in np.unique(index["q"]):
        own = np.flatnonzero(index["q"] == q)
        h = K.shingles(index["words"], int(q))
        for k in range(int(index["size"][own].max()) - int(q) + 1):
            has = own[k + q <= index["size"][own]]
            yield has, k, h[index["at"][has] + k], int(q)


def choose_prefixes(index: dict, counts: np.ndarray) -> dict:
    """Windows sorted by their rarest shingle; counts: of each of index["shingles"] in the corpus."""
    n = len(index["at"])
    least, offset, prefix = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int8), np.zeros(n, np.uint64)
    for has, k, h, _ in _offsets(index):
        c = counts[np.searchsorted(index["shingles"], h)]
        better = c < least[has]
        least[has[better]], offset[has[better]], prefix[has[better]] = c[better], k, h[better]
    order = np.argsort(prefix, kind="stable")
    kept = {k: index[k] for k in ("data", "starts", "ends")}
    kept |= {"prefix": prefix[order], "offset": offset[order], "q": index["q"][order].astype(np.int8), "size": index["size"][order].astype(np.int32), "key": index["key"][order], "at": index["at"][order].astype(np.int32)}
    first = np.searchsorted(index["window"], np.arange(n + 1))
    each = np.diff(first)[order]
    spread = np.repeat(first[:-1][order], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return kept | {"items": index["item"][spread], "first_item": np.concatenate([[0], np.cumsum(each)])}


def _shingle_counter(shared, qs: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            data, offsets = K.utf8(batch.column(0))
            for a, b in K.row_chunks(offsets):
                base = offsets[a]
                _, _, words, first = K.doc_words(data[base : offsets[b]], offsets[a : b + 1] - base, K.ALNUM)
                for q in qs:
                    h = K.shingles(words, q)
                    # Shingles that reach into the next document do not count.
                    ok = np.ones(len(h), bool)
                    for k in range(1, q):
                        cut = first[1:-1] - k
                        ok[cut[(cut >= 0) & (cut < len(h))]] = False
                    h = h[ok]
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    total += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["shingle", "n"])

    return count


def _match(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray, ix: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word position and index row of every occurrence of a window, over the words of several documents."""
    hits_at, hits_row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    doc_of, whole = None, {}
    for q in np.unique(ix["q"]):
        mine = np.flatnonzero(ix["q"] == q)
        prefix = ix["prefix"][mine]
        h = K.shingles(words, int(q))
        lo = np.searchsorted(prefix, h, "left")
        pos = np.flatnonzero((lo < len(prefix)) & (prefix[np.minimum(lo, len(prefix) - 1)] == h))
        if not len(pos):
            continue
        lo = lo[pos]
        n = np.searchsorted(prefix, h[pos], "right") - lo
        p = np.repeat(pos, n)
        row = mine[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        start = p - ix["offset"][row]
        if doc_of is None:
            doc_of = K.segment_rows(first)
        doc = doc_of[p]
        fits = (start >= first[doc]) & (start + ix["size"][row] <= first[doc + 1])
        start, row = start[fits], row[fits]
        for w in np.unique(ix["size"][row]):
            own = np.flatnonzero(ix["size"][row] == w)
            if w not in whole:
                whole[w] = K.shingles(words, int(w))
            own = own[whole[w][start[own]] == ix["key"][row[own]]]
            hits_at.append(start[own])
            hits_row.append(row[own])
    at, row = np.concatenate(hits_at), np.concatenate(hits_row)
    # Exact containment: the bytes of all words.
    told: dict[int, list[bytes]] = {}
    same = np.zeros(len(at), bool)
    for i, (s, r) in enumerate(zip(at.tolist(), row.tolist(), strict=True)):
        last = int(ix["size"][r]) - 1
        if r not in told:
            w = int(ix["at"][r])
            told[r] = ix["data"][ix["starts"][w] : ix["ends"][w + last]].split()
        same[i] = data[starts[s] : ends[s + last]].tobytes().translate(_PLAIN).split() == told[r]
    return at[same], row[same]


def _matcher(shared, ids_shared, schema: pa.Schema):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, ids = shared.value, ids_shared.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            old_spans, old_items = batch.column("spans"), batch.column("items")
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for a, b in K.row_chunks(offsets):
                base = offsets[a]
                part = data[base : offsets[b]]
                starts, ends, words, first = K.doc_words(part, offsets[a : b + 1] - base, K.ALNUM)
                n_words[a:b] = np.diff(first)
                start, row = _match(part, starts, ends, words, first, ix)
                by_doc = np.argsort(start, kind="stable")
                start, row = start[by_doc], row[by_doc]
                bounds = np.searchsorted(start, first)
                for d in np.flatnonzero(np.diff(bounds)):
                    s, r = start[bounds[d] : bounds[d + 1]] - first[d], row[bounds[d] : bounds[d + 1]]
                    spans[a + d] = np.column_stack([s, s + ix["size"][r]])
                    rows = np.unique(r)
                    own = np.concatenate([ix["items"][ix["first_item"][x] : ix["first_item"][x + 1]] for x in rows])
                    items[a + d] = {ids[x] for x in own}
            flat_spans, flat_items, n_hit = [], [], np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                before = old_spans[i].as_py() if spans[i] is not None or len(old_spans[i]) else []
                found = [list(x) for x in (spans[i].tolist() if spans[i] is not None else [])] + [[before[k], before[k + 1]] for k in range(0, len(before), 2)]
                merged: list[int] = []
                for s, e in sorted(found):
                    if merged and s <= merged[-1]:
                        merged[-1] = max(merged[-1], e)
                    else:
                        merged += [s, e]
                flat_spans.append(merged)
                n_hit[i] = sum(merged[1::2]) - sum(merged[::2])
                flat_items.append(sorted((items[i] or set()) | set(old_items[i].as_py() if len(old_items[i]) else []), key=lambda x: (x is None, x or 0)))
            new = {"n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "spans": pa.array(flat_spans, pa.list_(pa.int64())), "items": pa.array(flat_items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new.get(f.name, None) if f.name in new else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return match


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Benchmark windows in every document.

    Returns the ``keep`` columns, ``n_words``, ``n_hit``, ``spans`` (merged word ranges,
    flat: start, end, start, end ...), ``items`` (sorted distinct ids, null last) and, if
    asked for, ``text``.

    A null text has no words. Items without words or text match nothing; items with a
    null id are one item, without a name in the digest; a repeated item id is listed once. Empty
    tables give no hits or no rows. Repeated documents are reported each. A very long text is
    walked alone, with arrays of some dozen times its bytes. Columns that are not named are
    ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    sc = spark.sparkContext
    state = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<long>").alias("items"),
    )
    blocks = _item_blocks(benchmark, block_bytes)
    block = next(blocks, ([], []))
    while block is not None:
        following = next(blocks, None)
        ids, texts = block
        index = index_items(ids, texts)
        counts = np.zeros(len(index["shingles"]), np.int64)
        if len(counts):
            seen = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
                _shingle_counter(sc.broadcast(index["shingles"]), np.unique(index["q"]).tolist()), "shingle long, n long"
            )
            found: pd.DataFrame = seen.groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
            counts[found["shingle"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        out = state.schema if following is not None or carry_text else state.drop("text").schema
        state = state.mapInArrow(_matcher(sc.broadcast(choose_prefixes(index, counts)), sc.broadcast(ids), to_arrow_schema(out)), out)
        block = following
    return state.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], *(["text"] if carry_text else []), "n_words", "n_hit", "spans", "items")


def leak_digest(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


LEAKS_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
b AS (SELECT item_id, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, up),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
