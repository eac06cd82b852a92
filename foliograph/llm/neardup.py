"""Near-duplicate detection by an inverted join over MinHash signature coordinates.

A document's set (five-word shingles) has a signature of ``COORDS`` minima. Documents are
posted under (coordinate, value) pairs; two documents are candidates if they collide in at
least ``matches`` coordinates. At a similarity of 0.75 the number of collisions has mean 48
and standard deviation 3.5, so a pair at the very threshold is missed with a chance of a
few in a million, and pairs above it less often still.

*Prefix*: a pair with ``matches`` collisions shares one of any ``COORDS - matches + 1``
coordinates chosen by a common order, so documents are posted under their rarest ones
only; frequent values (shared passages) are skipped and enter only in the count. Lists are
first counted, with partial sums, and only postings of lists with several members are
shuffled (a filter of fixed size tells most of them; what it lets through is extra work).

*No pair explosion*: equal sets collapse to one, known by its smallest row. Short lists
give pairs, of which two bits of each minimum must agree often enough; a long list links
its members with its first member. Each set is confirmed with that one of these partners
with which most of the two-bit fragments agree, and links are joined into components. Pairs and lists that lie in
one component by then are done. Lists that still hold several are compared across
components in blocks, on signatures in numpy: a first time for the best partner of each
set, which is confirmed and joins components, and then for all pairs that are still apart.
They are confirmed on full sets, which meet in cells of two blocks of bounded size, never
a whole list in one task.

Neither documents nor full sets are stored: sets are made again from the texts that take
part, which a filter of fixed size picks by a hash. Hashes of words and shingles are 64 bits
of random sums (``kernels``); a set of n shingles is one too small with chance n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import materialize, scratch_scope
from .components import connected_components

SHINGLE = 5
COORDS = 64
#: Similarity as a ratio of integers.
NUM, DEN = 75, 100
#: Slots of the rarity table: as many as there are sets, up to this power of two.
RARITY_BITS = 20
#: Members of a posting list compared at once.
LIST_BLOCK = 4096
#: Shingles of the sets of a block; cells of two blocks are confirmed at once.
BLOCK_SHINGLES = 1 << 18
#: Members of a list that is compared directly.
SHORT_LIST = 32
#: Sets in lists that stay open are told apart by more coordinates, of one byte each.
SHARP_COORDS = 256
#: Bits of the filters that tell which rows to read again; fixed sizes, false hits are only extra work.
FILTER_BITS = 1 << 24



@dataclass(frozen=True)
class Filters:
    """How much of two signatures must agree before full sets are compared.

    ``matches`` of the 64 coordinates (mean 48, deviation 3.5 at a similarity of 0.75), in short lists ``fragments`` of the
    two-bit fragments (mean 52, deviation 3.1), in lists that stay open ``sharp`` of the 256 bytes (192 agree, deviation 6.9).
    """

    matches: int = 32
    fragments: int = 37
    sharp: int = 158


USUAL = Filters()
#: Every pair that shares a single coordinate is compared on full sets: a pair at the threshold shares none with chance 0.25 ** 64.
EXACT = Filters(1, 0, 0)

_rng = np.random.Generator(np.random.PCG64(97))
_MUL, _SHARP_MUL = (_rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (COORDS, SHARP_COORDS))
_ADD, _SHARP_ADD = (_rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (COORDS, SHARP_COORDS))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    data, offsets = K.utf8(column)
    for a, b in K.row_chunks(offsets):
        base = offsets[a]
        _, _, words, first = K.doc_words(data[base : offsets[b]], offsets[a : b + 1] - base, K.NOT_SPACE)
        h = K.shingles(words, SHINGLE)
        for i in range(b - a):
            n = int(first[i + 1] - first[i])
            if n >= SHINGLE:
                yield np.unique(h[first[i] : first[i] + n - SHINGLE + 1])
            elif n:
                yield K.shingles(words[first[i] : first[i + 1]], n)
            else:
                yield np.zeros(0, np.uint64)


def signature(values: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    low = np.full(len(mul), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(low, ((values[i : i + 1024, None] * mul + add) >> np.uint64(32)).min(axis=0), out=low)
    return low.astype(np.uint32)


#: Two hashes of a text, and two of a document, which is known by id and text.
TEXT = [F.xxhash64, lambda *c: F.xxhash64(F.lit(77), *c)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key, sig = [], [], []
        for s in shingle_sets(batch.column(batch.num_columns - 1)):
            n.append(len(s))
            key.append(np.array([s.sum(), np.bitwise_xor.reduce(K.mix(s.copy() + np.uint64(77)))], np.uint64).tobytes() if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], [*batch.schema.names[:-1], "n_shingles", "key", "sig"])
    K.release()


def _tokens(sig: np.ndarray) -> np.ndarray:
    """(rows, COORDS) uint32 to 64-bit posting keys: a hash of value and coordinate."""
    return K.mix((sig.astype(np.uint64) << np.uint64(8)) | np.arange(COORDS, dtype=np.uint64))


def _slots(tokens: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each token in a table of a power of two."""
    return (tokens >> np.uint64(32)).astype(np.int64) & (slots - 1)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _slot_counter(slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            total += np.bincount(_slots(_tokens(_signatures(batch.column(0))), slots).ravel(), minlength=slots)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    return count


def _rarity(sets: DataFrame, n_sets: int) -> np.ndarray:
    slots = 1 << min(RARITY_BITS, max(8, n_sets.bit_length()))
    counted = sets.select("sig").mapInArrow(_slot_counter(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(slots, np.uint32)
    table[counted["slot"].to_numpy(np.int64)] = np.minimum(counted["n"].to_numpy(np.int64), 0xFFFFFFFF)
    return table


def _prefix_order(sig: np.ndarray, rarity: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys and the coordinates of the prefix of each row, in one order for all rows."""
    tokens = _tokens(sig)
    order = np.lexsort((tokens, rarity[_slots(tokens, len(rarity))]), axis=1)[:, : COORDS - matches + 1]
    return tokens, order


def _fragments(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each coordinate, in two 64-bit words."""
    low = (sig & np.uint32(3)).astype(np.uint64)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return tuple(np.bitwise_or.reduce(low[:, k : k + 32] << shifts, axis=1).view(np.int64) for k in (0, 32))


def _agreeing(f: Column, g: Column) -> Column:
    """How many of the 32 fragments of two words agree."""
    x = f.bitwiseXOR(g)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return F.lit(32) - F.bit_count(x)


def _posted(rarity, matches: int):
    """(token) of every posting, to be counted."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, order = _prefix_order(_signatures(batch.column(1)), rarity.value, matches)
            sid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(tokens, order, 1).ravel().view(np.int64)), pa.array(sid)], ["token", "sid"])
        K.release()

    return post


def _poster(rarity, marked, matches: int):
    """Postings of the lists that the filter knows, with their fragments."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column(1))
            tokens, order = _prefix_order(sig, rarity.value, matches)
            keys = np.take_along_axis(tokens, order, 1)
            at, k = np.nonzero(_hit(keys.view(np.int64).ravel(), marked.value).reshape(keys.shape))
            f1, f2 = _fragments(sig)
            sid = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at, k].view(np.int64)), pa.array(order[at, k].astype(np.int32)), pa.array(sid[at]), pa.array(f1[at]), pa.array(f2[at])], ["token", "coord", "sid", "f1", "f2"])
        K.release()

    return post


def _filter_slot(values: np.ndarray) -> np.ndarray:
    return (K.mix(values.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _hit(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = _filter_slot(values)
    return ((bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = _filter_slot(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])


def _bitmap(values: DataFrame) -> np.ndarray:
    """A filter of fixed size of the one column of ``values``, which has no nulls."""
    marks = values.mapInArrow(_marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS >> 6, np.uint64)
    bitmap[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def _picker(marked):
    """The rows whose first column the filter knows."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hit(batch.column(0).to_numpy(zero_copy_only=False), marked.value)))
        K.release()

    return pick


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if DEN * len(x) < NUM * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _confirm(key: tuple, texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Links among the pairs of a cell, on full sets. Pairs that earlier links already join are left out."""
    held = dict(zip(texts["sid"], shingle_sets(pa.array(texts["text"], pa.large_string())), strict=True))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for a, others in zip(pairs["a"], pairs["bs"], strict=True):
        for b in others:
            ra, rb = find(a), find(b)
            if ra != rb and _linked(held[a], held[b]):
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    held.clear()
    K.release()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _verified(pairs: DataFrame, need: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (lo, hi, a, bs) that are links, as (a, b); need: (lo, hi, sid), the sets of each cell, each once."""
    held = need.select(F.col("lo").alias("cell_lo"), F.col("hi").alias("cell_hi"), "sid").join(texts, "sid")
    return held.groupBy("cell_lo", "cell_hi").cogroup(pairs.groupBy("lo", "hi")).applyInPandas(_confirm, "a long, b long")


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The members of the blocks of lists in a bucket, packed, one row for each cell that compares them."""
    out = []
    for (token, own), part in rows.groupby(["token", "own"]):
        nb = int(part["nb"].iloc[0])
        packed = [part[c].to_numpy(np.int64).tobytes() for c in ("sid", "label", "blk")] + [b"".join(part[c]) for c in ("sig", "mask", "sharp")]
        out += [(token, min(own, k), max(own, k), own, int(part["coord"].iloc[0]), *packed) for k in range(nb)]
    return pd.DataFrame(out, columns=[x.split()[0] for x in PACKED.split(", ")])


PACKED = "token long, i int, j int, own int, coord int, sid binary, label binary, blk binary, sig binary, mask binary, sharp binary"


def _compare_lists(key: tuple, rows: pd.DataFrame, best: bool = False, at: Filters = USUAL) -> pd.DataFrame:
    """Pairs across components in the cells of a bucket that collide often enough; or the best one of each set."""
    out = []
    for (_, i, j), cell in rows.groupby(["token", "i", "j"]):
        coord = int(cell["coord"].iloc[0])
        cell = cell.sort_values("own")
        sid, label, blk = (np.concatenate([np.frombuffer(x, np.int64) for x in cell[c]]) for c in ("sid", "label", "blk"))
        sig = np.frombuffer(b"".join(cell["sig"]), np.uint32).reshape(-1, COORDS)
        mask = np.unpackbits(np.frombuffer(b"".join(cell["mask"]), np.uint8).reshape(len(sid), -1), axis=1)[:, :COORDS].astype(bool)
        sharp = np.frombuffer(b"".join(cell["sharp"]), np.uint8).reshape(-1, SHARP_COORDS)
        n_left = len(cell["sid"].iloc[0]) // 8
        for x in range(n_left):
            right = slice(x + 1 if i == j else n_left, None)
            ys = np.flatnonzero(label[right] != label[x]) + right.start
            if not len(ys):
                continue
            same = sig[ys] == sig[x]
            ys, same = ys[(n := same.sum(axis=1)) >= at.matches], same[n >= at.matches]
            alike = (sharp[ys] == sharp[x]).sum(axis=1)
            near = alike >= at.sharp
            ys, same, alike = ys[near], same[near], alike[near]
            if not len(ys):
                continue
            if best:
                y = ys[alike.argmax()]
                out.append((sid[x], blk[x], blk[y], [sid[y]], alike.max()))
                continue
            # A pair that meets in several lists belongs to that of the first common coordinate.
            first = (same & mask[ys] & mask[x]).argmax(axis=1) == coord
            ys = ys[first]
            for b in np.unique(blk[ys]):
                out.append((sid[x], blk[x], b, sid[ys[blk[ys] == b]], 0))
    return pd.DataFrame(out, columns=["a", "blk_a", "blk_b", "bs", "alike"])


def _masker(rarity, matches: int):
    """The coordinates of the prefix as bits, and the sharper sketch of the text."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, order = _prefix_order(_signatures(batch.column(1)), rarity.value, matches)
            bits = np.zeros((batch.num_rows, COORDS), np.uint8)
            np.put_along_axis(bits, order, 1, axis=1)
            sharp = [signature(s, _SHARP_MUL, _SHARP_ADD).astype(np.uint8).tobytes() for s in shingle_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary()), pa.array(sharp, pa.binary())], ["sid", "sig", "mask", "sharp"])
        K.release()

    return mask


def near_duplicates(docs: DataFrame, at: Filters = USUAL) -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id, kept) of every document; ``doc_id`` is a long.

    ``at`` says how much of two signatures must agree before sets are compared; ``EXACT`` compares all that share
    anything, and misses nothing at far more work.

    A null text and a text without words have an empty set and no links. A null doc_id
    takes part in links but never names a component, unless all its members are null;
    then the component is null and its first row is kept. Repeated ids are rows of
    their own with one id. Of rows that share the smallest id of a component, all say
    kept. A very long text counts by its shingles when blocks are filled, and one longer
    than a block is held whole by its cell. Other columns are ignored. An empty table gives
    an empty result.
    """
    with scratch_scope(docs.sparkSession) as keep:
        keep.append(materialize(_near_duplicates(docs, at).drop("root", "i1", "i2"), "dup-result"))
    return keep[0]


def _stars(sets: DataFrame, rarity, at: Filters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of short lists (a, b), places of sets in long lists (sid, places), and (sid, head) with the partner of each set that agrees with it most."""
    spark = sets.sparkSession
    lists = sets.select("sid", "sig").mapInArrow(_posted(rarity, at.matches), "token long, sid long").groupBy("token").agg(F.min("sid").alias("head"), F.count("*").alias("m"))
    lists = materialize(lists.where("m > 1"), "dup-lists")
    known = spark.sparkContext.broadcast(_bitmap(lists.select("token")))
    postings = sets.select("sid", "sig").mapInArrow(_poster(rarity, known, at.matches), "token long, coord int, sid long, f1 long, f2 long")
    members = materialize(postings.join(lists, "token"), "dup-members")
    short = members.where(F.col("m") <= SHORT_LIST)
    left = short.select("token", F.col("sid").alias("a"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    right = short.select("token", F.col("sid").alias("b"), "f1", "f2")
    alike = (_agreeing(F.col("f1"), F.col("g1")) + _agreeing(F.col("f2"), F.col("g2"))).alias("alike")
    pairs = left.join(right, (left["token"] == right["token"]) & (F.col("a") < F.col("b"))).select("a", "b", alike).where(F.col("alike") >= at.fragments)
    near = materialize(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")), "dup-near")
    long = members.where(F.col("m") > SHORT_LIST)
    first = long.where("sid = head").select("token", F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    long = long.join(first, "token").select("token", "coord", "sid", "head", alike)
    alone = F.lit(-1).alias("alike")
    heads = near.select(F.col("a").alias("head"), F.col("b").alias("sid"), "alike").unionByName(near.select(F.col("a").alias("head"), F.col("a").alias("sid"), alone))
    heads = heads.unionByName(long.select("head", "sid", F.when(F.col("sid") > F.col("head"), F.col("alike")).otherwise(-1).alias("alike")))
    best = heads.groupBy("sid").agg(F.max(F.struct("alike", (-F.col("head")).alias("first"), "head")).alias("h"))
    # A set's places in long lists, a prefix of them at most, stay together where they are joined by set.
    placed = materialize(long.groupBy("sid").agg(F.collect_list(F.struct("token", "coord")).alias("places")), "dup-long")
    return near.drop("alike"), placed, materialize(best.select("sid", "h.head"), "dup-heads")


def _near_duplicates(docs: DataFrame, at: Filters = USUAL) -> DataFrame:
    """near_duplicates with the component's root and two hashes of id and text."""
    spark = docs.sparkSession
    own = [h("doc_id", "text").alias(f"i{k}") for k, h in enumerate(TEXT, 1)]
    of_text = [h("text").alias(f"h{k}") for k, h in enumerate(TEXT, 1)]
    signed = docs.select("doc_id", *own, *of_text, "text").mapInArrow(_sign, "doc_id long, i1 long, i2 long, h1 long, h2 long, n_shingles long, key binary, sig binary")
    rows = materialize(signed.withColumn("row_id", F.monotonically_increasing_id()), "dup-signatures")
    # Sets that are equal are one; it is known by its smallest row.
    sets = rows.where("n_shingles > 0").groupBy("key", "n_shingles").agg(F.min(F.struct(F.col("row_id").alias("sid"), "h1", "h2", "sig")).alias("s"), F.min("doc_id").alias("set_doc"))
    sets = materialize(sets.select("key", "n_shingles", "set_doc", "s.*"), "dup-sets")
    rarity = spark.sparkContext.broadcast(_rarity(sets, sets.count()))
    near, long, heads = _stars(sets, rarity, at)

    # Blocks of related sets: those with the same first partner, split where they have many shingles.
    heads = heads.join(sets.select("sid", "n_shingles", "h1", "h2"), "sid")
    sizes = heads.groupBy("head").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("parts"), F.sum("n_shingles").alias("w"))
    sizes = materialize(sizes, "dup-block-sizes")
    n_blocks = -(-(sizes.agg(F.sum("w")).first()[0] or 1) // BLOCK_SHINGLES)
    blk = F.when(F.col("parts") <= 1, F.pmod(F.xxhash64("head"), F.lit(n_blocks))).otherwise(F.xxhash64("head", F.pmod(F.xxhash64("sid"), F.col("parts"))))
    blocks = materialize(heads.join(sizes, "head").select("sid", "head", blk.alias("blk"), "h1", "h2"), "dup-blocks")

    # The texts of these sets, one for each: equal texts meet as one, by their hashes.
    marked = spark.sparkContext.broadcast(_bitmap(blocks.select("h1")))
    texts = docs.select(*of_text, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_picker(marked), "h1 long, h2 long, text string")
    texts = texts.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(blocks.select("sid", "h1", "h2"), ["h1", "h2"]).select("sid", "text")
    texts = materialize(texts, "dup-texts")

    # Stars: a cell is a block with the heads of its sets.
    void = F.lit(0).cast("long").alias("hi")
    arms = blocks.where("sid <> head").select(F.col("blk").alias("lo"), void, F.col("head").alias("a"), F.array("sid").alias("bs"))
    need = arms.select("lo", "hi", F.col("a").alias("sid")).unionByName(arms.select("lo", "hi", F.col("bs")[0].alias("sid"))).distinct()
    labels = connected_components(materialize(_verified(arms, need, texts), "dup-stars"))
    labels = blocks.join(labels.select(F.col("node").alias("sid"), F.col("root").alias("label")), "sid", "left").select("sid", "blk", F.coalesce("label", "sid").alias("label"))
    labels = materialize(labels, "dup-labels")

    for best in (True, False):
        labels = _joined(_crossing(near, long, labels, sets, texts, rarity, best, at), texts, labels)
    parts = labels.select("sid", F.col("label").alias("root"))
    named = sets.select("key", "n_shingles", "sid", "set_doc").join(parts, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = materialize(named, "dup-named")
    names = named.groupBy("root").agg(F.min("set_doc").alias("component"))
    names = materialize(named.join(names, "root").select("key", "n_shingles", "component", "root"), "dup-names")
    out = rows.drop("sig", "h1", "h2").join(names, ["key", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("row_id", "doc_id", "n_shingles", component.alias("component_id"), "root", "i1", "i2")
    kept = F.when(F.col("component_id").isNull(), F.col("root").isNull() | (F.col("root") == F.col("row_id"))).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.withColumn("kept", kept)


def _joined(crossing: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the components that confirmed links join as one."""
    cell = [F.least("blk_a", "blk_b").alias("lo"), F.greatest("blk_a", "blk_b").alias("hi")]
    crossing = materialize(crossing.select(*cell, "a", "bs"), "dup-crossing")
    # The sets of a cell, each once, before they become rows; their number is bounded by the two blocks.
    sids = F.array_union(F.collect_set("a"), F.array_distinct(F.flatten(F.collect_list("bs"))))
    need = crossing.groupBy("lo", "hi").agg(sids.alias("sids")).select("lo", "hi", F.explode("sids").alias("sid"))
    links = materialize(_verified(crossing, need, texts), "dup-links")
    of = lambda c: labels.select(F.col("sid").alias(c), F.col("label").alias(f"label_{c}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    parts = connected_components(joined).select(F.col("node").alias("label"), "root")
    return materialize(labels.join(parts, "label", "left").select("sid", "blk", F.coalesce("root", "label").alias("label")), "dup-labels")


def _crossing(near: DataFrame, long: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame, rarity, best: bool, at: Filters) -> DataFrame:
    """(a, blk_a, blk_b, bs): candidates of short and long lists that lie in different components.

    With ``best`` each set has the one partner of long lists that is most like it, and pairs
    of short lists wait.
    """
    of = lambda c: labels.select(F.col("sid").alias(c), F.col("label").alias(f"label_{c}"), F.col("blk").alias(f"blk_{c}"))
    known = long.join(labels, "sid").select("sid", "blk", "label", F.explode("places").alias("p")).select("sid", "blk", "label", "p.token", "p.coord")
    open_lists = known.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x <> y")
    open_lists = materialize(open_lists.select("token", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("nb")), "dup-open-lists")
    members = known.join(open_lists, "token").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    members = materialize(members, "dup-open")
    signed = members.select("sid").distinct().join(sets.select("sid", "sig"), "sid").join(texts, "sid")
    signed = signed.mapInArrow(_masker(rarity, at.matches), "sid long, sig binary, mask binary, sharp binary")
    n_buckets = max(64, -(-members.count() // 4096))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_buckets)).alias("bucket")
    packed = members.join(signed, "sid").groupBy(bucket("token", "own")).applyInPandas(_pack, PACKED)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _compare_lists(key, rows, best, at)

    found = packed.groupBy(bucket("token", "i", "j")).applyInPandas(compare, "a long, blk_a long, blk_b long, bs array<long>, alike long")
    if best:
        return found.groupBy("a").agg(F.max(F.struct("alike", "blk_a", "blk_b", "bs")).alias("p")).select("a", "p.blk_a", "p.blk_b", "p.bs")
    apart = near.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b").select("a", "blk_a", "blk_b", F.array("b").alias("bs"))
    return found.drop("alike").unionByName(apart)


def keep_one_each(docs: DataFrame, at: Filters = USUAL) -> DataFrame:
    """The documents without those that a link joins to a smaller id; one row of each component stays.

    Rows are as in ``near_duplicates``; of rows equal in id and text any one stays. All
    columns are returned as they are. Documents that stay are not shuffled but for those
    that a filter of fixed size confuses with one that goes.
    """
    spark = docs.sparkSession
    with scratch_scope(spark) as keep:
        found = materialize(_near_duplicates(docs, at), "dup-result")
        first = found.where("kept").groupBy(F.coalesce(F.col("root"), -1 - F.col("row_id")).alias("part")).agg(F.min("row_id").alias("row_id"))
        stays = found.select("row_id", "i1", "i2").join(first.select("row_id", F.lit(1).alias("stay")), "row_id", "left")
        fate = stays.groupBy("i1", "i2").agg(F.count("*").alias("n"), F.count("stay").alias("k")).where("k < n")
        fate = materialize(fate.select(F.col("i1").alias("_i1"), F.col("i2").alias("_i2"), F.col("k").alias("_k")), "dup-fate")
        keep.append(fate)
        marked = spark.sparkContext.broadcast(_bitmap(fate.select("_i1")))

    @F.pandas_udf("boolean")
    def suspect(h: pd.Series) -> pd.Series:
        return pd.Series(_hit(h.to_numpy(np.int64), marked.value))

    names = [f"c{i}" for i in range(len(docs.columns))]
    mine = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    slim = docs.toDF(*names)
    for k, h in enumerate(TEXT, 1):
        slim = slim.withColumn(f"i{k}", h(mine["doc_id"], mine["text"]))
    slim = slim.withColumn("suspect", suspect("i1"))
    clean = slim.where(~F.col("suspect")).select(names)
    held = slim.where("suspect").join(fate, (F.col("i1") == F.col("_i1")) & (F.col("i2") == F.col("_i2")), "left")
    nth = F.row_number().over(W.partitionBy("i1", "i2").orderBy("i1"))
    held = held.where("_k is null or _k > 0").withColumn("nth", nth).where("_k is null or nth <= _k").select(names)
    return clean.unionByName(held).toDF(*docs.columns)
