"""Source divergence audit: how far a source's vocabulary is from its language's and from other sources'.

Two passes with a vocabulary automaton. The first counts in how many documents of its language
each term stands, exactly, and keeps terms of ``MIN_DOCS`` documents. The second scans whole texts,
every other character turned into a delimiter, with an Aho-Corasick automaton of the kept terms,
each padded with delimiters, and counts occurrences. The vocabulary is cut into blocks of bounded
size; a block's automaton is the only thing broadcast, and a document meets its own language's part.

The counts are sparse postings by term. A group's share of a term is smoothed, so absent terms
have a share too; sums over all kept terms are put together from what holds for absent
terms alone, histograms of each group's counts, and a correction for terms that two groups share.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

MIN_DOCS = 3
TOP_TERMS = 200
#: Characters and terms in one block of the vocabulary; about 120 MB of automaton at most.
BLOCK_CHARS = 8_000_000
BLOCK_TERMS = 1_000_000
#: A task's counts are handed on when they hold so many terms or bytes.
FLUSH_TERMS = 400_000
FLUSH_BYTES = 32_000_000
#: Bytes scanned at once, and pairs of postings compared at once.
SCAN_BYTES = 4_000_000
PAIRS = 1_000_000

#: Letters a-z and all bytes beyond ASCII stand, A-Z are lower-cased, all else delimits.
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _folded(batch: pa.RecordBatch, column: int) -> tuple[bytes, np.ndarray]:
    data, offsets = K.utf8(batch.column(column))
    return data.tobytes().translate(FOLD), offsets


def _texts(counts: list[bytes]) -> pa.Array:
    return pa.array(counts, pa.binary()).cast(pa.string())


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents): each document's distinct terms, counted by language."""
    counts: dict[str, Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), _texts(list(c)), pa.array(c.values(), pa.int64())], ["lang", "term", "n"])
        counts.clear()

    for batch in batches:
        folded, offsets = _folded(batch, 1)
        for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            counts.setdefault(lang, Counter()).update(set(folded[a:b].split()))
            size += int(b - a)
            if size > FLUSH_BYTES and sum(map(len, counts.values())) > FLUSH_TERMS or size > 8 * FLUSH_BYTES:
                yield from flush()
                size = 0
    yield from flush()
    K.release()


Automata = dict[str, tuple[ahocorasick.Automaton, np.ndarray]]
#: The automata of the block that this worker scans for at present.
_built: dict[str, Automata] = {}


def _automata(key: str, block: Broadcast) -> Automata:
    """An automaton and the ids of its terms for each language of the block; a worker builds them once.

    Frequent terms go in first, so that the states visited most lie close together.
    """
    if key not in _built:
        _built.clear()
        automata: Automata = {}
        for lang, (terms, ids) in block.value.items():
            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(terms.to_pylist()):
                found.add_word(f" {term} ", i)
            found.make_automaton()
            automata[lang] = found, ids
        _built[key] = automata
    return _built[key]


def _occurrences(key: str, block: Broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(key, block)
        for batch in batches:
            folded, offsets = _folded(batch, 2)
            groups: dict[tuple[str, str], list[int]] = {}
            for row, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                groups.setdefault(group, []).append(row)
            for (lang, source), rows in groups.items():
                if lang not in automata:
                    continue
                found, ids = automata[lang]
                n = np.zeros(len(ids), np.int64)
                for some in _parts(rows, offsets):
                    text = b" ".join([b"", *[folded[offsets[r] : offsets[r + 1]] for r in some], b""]).decode()
                    n += np.bincount(np.fromiter(map(itemgetter(1), found.iter(text)), np.int64), minlength=len(ids))
                seen = np.flatnonzero(n)
                same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(seen), np.int32)), [x]).cast(pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids[seen]), pa.array(n[seen])], ["lang", "source", "id", "n"])

    return scan


def _parts(rows: list[int], offsets: np.ndarray) -> Iterator[list[int]]:
    """The rows in runs of about ``SCAN_BYTES``; a longer text stands alone."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += int(offsets[r + 1] - offsets[r])
        if size > SCAN_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 * (n + 1) / total)`` in 64 bits for totals up to 9 * 10^13."""
    x = (n + 1) * 100_000
    return 1 + x // total * 10_000 + x % total * 10_000 // total


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _share_sql(n: str, total: str) -> str:
    x = f"(({n}) + 1L) * 100000L"
    return f"(1L + ({x}) div ({total}) * 10000L + ({x}) % ({total}) * 10000L div ({total}))"


def _gap_sql(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ordered pair of sources what the terms that both have add to the sum, beyond what each of them adds alone."""
    for batch in batches:
        langs, kept, posts = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
        at = posts.offsets.to_numpy()
        cells = posts.values
        sources = cells.field(0).dictionary_encode()
        names, source = sources.dictionary.to_pylist(), sources.indices.to_numpy().astype(np.int64)
        n, total = cells.field(1).to_numpy(), cells.field(2).to_numpy()
        lang_names = sorted(set(langs))
        place = {x: i for i, x in enumerate(lang_names)}
        lang = np.array([place[x] for x in langs], np.int64)
        length = np.diff(at)
        row = np.repeat(np.arange(len(at) - 1), length)
        first = np.arange(at[0], at[-1])
        # One entry for each posting: how many others it meets; blocks of bounded number of pairs.
        meets = np.concatenate([[0], np.cumsum(length[row])])
        a = 0
        while a < len(first):
            b = max(int(np.searchsorted(meets, meets[a] + PAIRS, "right")) - 1, a + 1)
            many = length[row[a:b]]
            left = np.repeat(first[a:b], many)
            step = np.arange(len(left)) - np.repeat(meets[a:b] - meets[a], many)
            right = np.repeat(at[:-1][row[a:b]], many) + step
            apart = left != right
            left, right, at_row = left[apart], right[apart], np.repeat(row[a:b], many)[apart]
            a = b
            if not len(left):
                continue
            v = kept[at_row]
            ma, mb = total[left] + v, total[right] + v
            pa_, pb, za, zb = share(n[left], ma), share(n[right], mb), share(np.zeros_like(ma), ma), share(np.zeros_like(mb), mb)
            more = gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)
            code = (lang[at_row] * len(names) + source[left]) * len(names) + source[right]
            order = np.argsort(code)
            code, more = code[order], more[order]
            start = np.flatnonzero(np.diff(code, prepend=-1))
            sums, code = np.add.reduceat(more, start), code[start]
            pair = code % (len(names) * len(names))
            out = [np.array(lang_names, object)[code // (len(names) * len(names))], np.array(names, object)[pair // len(names)], np.array(names, object)[pair % len(names)]]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in out], pa.array(sums)], ["lang", "source", "item", "more"])


def _blocks(vocabulary: DataFrame) -> Iterator[dict[str, tuple[pa.Array, np.ndarray]]]:
    """Blocks of kept terms by language, each of bounded size; terms fall to blocks by hash."""
    chars, terms = vocabulary.agg(F.sum(F.octet_length("term") + 2), F.count("*")).first()
    blocks = max(-(-(chars or 0) // BLOCK_CHARS), -(-terms // BLOCK_TERMS), 1) if terms else 0
    for k in range(blocks):
        part = vocabulary.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).select("lang", "term", "id", "n").toArrow().combine_chunks()
        out = {}
        for lang in part.column("lang").unique().to_pylist():
            own = part.filter(pa.compute.equal(part.column("lang"), lang)).sort_by([("n", "descending")])
            out[lang] = own.column("term").combine_chunks(), own.column("id").to_numpy()
        yield out


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (``lang, term, n, id``; n documents) and their occurrences by group (``lang, source, id, n``).

    ``docs`` has ``lang, source, text`` without nulls. Both tables are written to the shared folder.
    """
    spark = docs.sparkSession
    found = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    vocabulary = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    vocabulary = materialize(vocabulary.withColumn("id", F.monotonically_increasing_id()), "divergence-terms")
    counts = spark.createDataFrame([], "lang string, source string, id long, n long")
    for block in _blocks(vocabulary):
        mine = docs.where(F.col("lang").isin(sorted(block))).select("lang", "source", "text")
        shared = spark.sparkContext.broadcast(block)
        one = mine.mapInArrow(_occurrences(uuid.uuid4().hex, shared), "lang string, source string, id long, n long")
        counts = counts.unionByName(materialize(one.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "divergence-counts"))
        shared.unpersist()
    return vocabulary, counts


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group: divergences from the other sources, and its own marked terms.

    A null text, lang or source is the empty string, and so the same group as that. Repeated rows
    and ids are documents each. A language without kept terms has pairs of value 0 and no terms.
    Ties go to the item that is smaller in UTF-8 bytes. Texts are scanned whole however long. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vocabulary, counts = term_counts(docs, min_docs)
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "divergence-groups")
    posts = counts.join(groups.select("lang", "source", "total"), ["lang", "source"]).groupBy("lang", "id").agg(F.collect_list(F.struct("source", "n", "total")).alias("posts"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.max("kept").alias("kept"))
    posts = materialize(posts.join(vocabulary.select("lang", "id", "term"), ["lang", "id"]).join(langs, "lang"), "divergence-posts")
    return _pairs(posts, counts, groups).unionByName(_terms(posts, top_terms))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(posts: DataFrame, top_terms: int) -> DataFrame:
    whole = posts.withColumn("in_lang", F.expr("aggregate(posts, 0L, (s, x) -> s + x.n)"))
    rows = whole.select("lang", "term", F.expr(_share_sql("in_lang", "whole + kept")).alias("q"), "kept", F.explode("posts").alias("x"))
    rows = rows.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), "q", F.expr(_share_sql("x.n", "x.total + kept")).alias("p"))
    rows = rows.where("p > q").withColumn("value", F.expr(_gap_sql("p", "q")))
    return _ranked(rows, "term").where(F.col("rank") <= top_terms)


def _pairs(posts: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    both = posts.where(F.size("posts") > 1).select("lang", "kept", "posts").mapInArrow(_shared_terms, "lang string, source string, item string, more long")
    both = both.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    often = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("n", "terms")).alias("often"))
    own = groups.join(often, ["lang", "source"], "left").withColumn("often", F.expr("coalesce(often, array())"))
    other = own.select("lang", F.col("source").alias("item"), F.col("total").alias("total_b"), F.col("often").alias("often_b"))
    pairs = own.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.withColumns({"za": F.expr(f"if(kept = 0, 1L, {_share_sql('0L', 'total + greatest(kept, 1)')})"), "zb": F.expr(f"if(kept = 0, 1L, {_share_sql('0L', 'total_b + greatest(kept, 1)')})")})
    pairs = pairs.withColumn("absent", F.expr(_gap_sql("za", "zb")))
    alone = f"aggregate(often, 0L, (s, x) -> s + x.terms * ({_gap_sql(_share_sql('x.n', 'total + kept'), 'zb')} - absent))"
    alone_b = f"aggregate(often_b, 0L, (s, x) -> s + x.terms * ({_gap_sql('za', _share_sql('x.n', 'total_b + kept'))} - absent))"
    return _ranked(pairs.withColumn("value", F.expr(f"kept * absent + {alone} + {alone_b} + coalesce(more, 0L)")), "pair")


#: Every group and term densely, as the definition has it.
AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::BIGINT AS t FROM dense GROUP BY ALL),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (t + v))::BIGINT AS p FROM dense JOIN s USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(n)::BIGINT AS t FROM l GROUP BY lang),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (t + v))::BIGINT AS q FROM l JOIN lt USING (lang) JOIN v USING (lang)),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
