"""Spelling variant grouping by anagram hashing.

A word's key is the sum of a power for each of its letters, so that words of the same letters share
a key whatever their order, and one letter more, fewer or exchanged changes the key by that letter's
value. Two words that differ by one letter have a common rest: the shorter word, or both words
without the exchanged letter. Words are joined where their keys, less one letter's value or as they
are, agree; half of the rest, before or behind the place where they differ, stands in both words
letter by letter and is part of the join key, which keeps the anagrams out. The order of the
remaining letters is verified. Each word then points to its most frequent near word, if that is
frequent enough, and the chains of pointers are followed by doubling.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, scratch_scope

MIN_LETTERS = 5
MIN_COUNT = 3
#: A form has at least so many times the occurrences of its variant.
TIMES = 2
#: A run is misread where this divides its hash.
MISREAD = 97
#: A task's counts are handed on when they hold so many words or bytes.
FLUSH_WORDS = 400_000
FLUSH_BYTES = 32_000_000

#: Letters in Latin-1, A-Z lower-cased; all else is a blank.
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: A power for each letter: anagrams have one sum, and hardly anything else has.
_POWERS = np.array([(c + 1) ** 5 for c in range(256)], np.uint64)
_LINK = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The runs of letters, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(FOLD).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): occurrences of words of enough letters, misread ones as they then read."""
    counts: Counter = Counter()
    size = 0

    def flush() -> pa.RecordBatch:
        kept = {w: n for w, n in counts.items() if n and len(w) >= MIN_LETTERS}
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            seed = crc32(f"{batch.column(0)[i].as_py()}:".encode())
            found = words_of(text)
            counts.update(found)
            hashes = {w: crc32(_utf8(w), seed) for w in set(found)}
            misread = {w for w, h in hashes.items() if not h % MISREAD}
            for w, n in Counter(filter(misread.__contains__, found)).items() if misread else ():
                at = hashes[w] % len(w)
                counts[w] -= n
                counts[w[:at] + w[at + 1 :]] += n
            size += len(text)
            if size > FLUSH_BYTES and len(counts) > FLUSH_WORDS or size > 8 * FLUSH_BYTES:
                yield flush()
                size = 0
    yield flush()
    K.release()


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``MIN_LETTERS`` letters and ``min_count`` occurrences."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return slim.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _part_sums(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of ``codes`` by content and order; ranges may be empty and overlap others."""
    order = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), np.uint64)
    out[order] = K.range_hashes(codes, starts[order], ends[order])
    return out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cut, word, n): each word under the rests it can share with a near word.

    A rest of r letters is known by the sum of its powers, r, and its first half (the
    words differ behind it) or its second half (they differ before it). ``cut`` tells a word that is the rest from
    one that has a letter more.
    """
    for batch in batches:
        latin = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in latin])]).astype(np.int64)
        data = np.frombuffer(b"".join(latin), np.uint8)
        for a, b in K.row_chunks(offsets):
            at = offsets[a : b + 1] - offsets[a]
            letters = data[offsets[a] : offsets[b]]
            codes = K._BYTE_CODES[letters]
            length = np.diff(at)
            row = np.repeat(np.arange(b - a), length)
            place = np.arange(len(letters)) - at[row]
            whole = np.add.reduceat(_POWERS[letters], at[:-1])
            keys, cuts, rows = [], [], []
            for cut in (0, 1):
                rest = length - cut
                half = (rest + 1) // 2
                # The part that the two words have in common: the rest's first half stands first in both, the second half last.
                sides = _part_sums(codes, at[:-1], at[:-1] + half), _part_sums(codes, at[1:] - (rest - half), at[1:])
                for side, common in enumerate(sides):
                    stamp = K.mix(common + (rest * 4 + side).astype(np.uint64) * _LINK)
                    if not cut:
                        keys.append(K.mix(whole * _LINK + stamp))
                        rows.append(np.arange(b - a))
                    else:
                        # Letters at the places where the words may differ, each letter of a word once.
                        there = place >= half[row] if side == 0 else place < half[row]
                        once = K.first_of_each((row[there] * 256 + letters[there]).astype(np.uint64))
                        mine, letter = row[there][once], letters[there][once]
                        keys.append(K.mix((whole[mine] - _POWERS[letter]) * _LINK + stamp[mine]))
                        rows.append(mine)
                    cuts.append(np.full(len(rows[-1]), bool(cut)))
            rows_all = np.concatenate(rows)
            taken = pa.array(a + rows_all)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cuts)), batch.column(0).take(taken), batch.column(1).take(taken)], ["key", "cut", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """Each unordered pair of words one letter apart, once: ``word, n, other, other_n``."""
    posts = words.mapInArrow(_postings, "key long, cut boolean, word string, n long")
    posts = materialize(posts, "variants-postings")
    longer, other = posts.where("cut"), posts.select("key", F.col("cut").alias("other_cut"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # A longer word meets the rest itself, or another word that has one letter more than it.
    pairs = longer.join(other, "key").where("(not other_cut or word < other) and word <> other")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form, by doubling: a form has at least twice the occurrences, so chains are short and end."""
    chain = materialize(forms.select("word", F.col("form").alias("root")), "variants-chain")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(chain.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "variants-chain")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        chain = step.select("word", "root")


def group_variants(docs: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that is frequent enough.

    A null text has no words; a null id counts as the empty string where words are misread.
    Repeated rows count as often as they occur. Words without near words have no form and
    are their own root. Of near words as frequent as each other the smallest in code-point
    order is the form. Runs of letters are words however long. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    with scratch_scope(docs.sparkSession) as keep:
        words = materialize(word_counts(docs, min_count), "variants-words")
        pairs = near_words(words)
        both = pairs.select("word", "other", F.col("other_n").alias("m")).unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), "other")).alias("best"))
        found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("near"), (-F.col("best.col1")).alias("near_n"))
        far = F.col("near_n") >= times * F.col("n")
        found = materialize(found.select("word", "n", "n_near", F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n")), "variants-forms")
        roots = _roots(found.where("form is not null"))
        out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        keep.append(out)
    return out


#: The checksum is the byte-wise one with the reversed polynomial 0xEDB88320; near words meet in what is left without one letter.
VARIANTS_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') AS id, coalesce(text, '') AS text FROM documents),
runs AS (SELECT r, id, run, count(*) AS k FROM (SELECT r, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM d) GROUP BY ALL),
steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
bytes AS (SELECT run, k, list_transform(range(1, 2 * octet_length(encode(s)), 2), lambda i: ('0x' || substr(hex(encode(s)), i, 2))::BIGINT) AS b FROM (SELECT run, k, id || ':' || run AS s FROM runs)),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, steps),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {MISREAD} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.x = w.word UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.x = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN other END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS step FROM forms UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON walk.here = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) USING (word)
"""
