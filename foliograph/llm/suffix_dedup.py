"""Exact substring deduplication: bytes covered by a string of ``LENGTH`` bytes that starts again elsewhere.

A full suffix array over the corpus would move hundreds of bytes for each byte of text, so
suffixes are sparse and known by two hashes of their leading bytes, one of which gives the
bucket and one the key in it:

1. *Anchors.* Of the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes, the one of
   smallest hash is the window's anchor. A repeated window has equal anchors at either
   place, so only windows whose anchor occurs again can repeat. Between anchors that are
   ``LENGTH`` bytes apart lie *segments*; a segment that occurs again settles all windows
   in it at once.
2. *Buckets.* Anchor and segment keys are dealt to buckets, each bucket is sorted and equal
   neighbours are found. A key is sent once per block of documents, which has already
   compared its own, so a passage in a third of all documents is one row per block.
3. *Edges.* Windows with a repeated anchor that no segment settles lie at the edges of
   repeated passages. Their anchors, with where in the window they lie, are announced to
   every block that has them, since a settled window may be an unsettled one's only partner.
4. *Rest.* Unsettled windows, and announced ones of the segments for which a block speaks (the
   first of those that have it), go through the same buckets by their own keys.

Hashes run over the bytes in words of eight, with multiplication and shift at each step.
Two strings are taken for one only if key and bucket agree: 64 bits and the logarithm of
the buckets, which grow with the corpus (at 100 TB some 100,000: 81 bits, a chance of
about one in two that any false match occurs among 1.6e12 suffixes).
Every block of documents is read four times from one exchange. A block's documents are
chosen by a hash of what is kept and the text, so it is the same whenever a task runs again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import kernels as K
from .common import total_bytes

LENGTH = 200
GRAM = 80
#: Text of a block of documents, and text walked at once.
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 17
#: Bytes of keys in a bucket, roughly.
BUCKET_BYTES = 16 << 20
#: Text that a task holds blocks of.
TASK_BYTES = 32 << 20
_POSITION_BITS = 21
#: Bytes of a string that are hashed at once; LENGTH and GRAM are multiples.
STEP = 40
_M1, _M2, _M3 = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    blocks = -(-len(x) // w)
    y = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    y = y.reshape(blocks, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def _mixed(one: np.ndarray, a: np.ndarray, b: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state of two running hashes, in place."""
    one ^= a
    one *= _M1
    one ^= one >> np.uint64(32)
    two += b
    two *= _M2
    two ^= two >> np.uint64(31)
    return one, two


class Slice:
    """Windows, anchors and segments of some texts, or of a part of a long one.

    own: windows and segments that start before it belong to this slice; the bytes after
    it belong to the next slice of the same text.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, own: int):
        n = len(data)
        self.n_windows = max(n - LENGTH + 1, 0)
        # The eight bytes from each byte on, as one number, scrambled: texts that differ in few
        # bits must not differ in few bits here, or periodic ones cancel out in a chain.
        raw = np.ndarray((max(n - 7, 0),), "<u8", np.ascontiguousarray(data), 0, (1,)) if n >= 8 else np.zeros(0, np.uint64)
        self.words = raw * _M2
        self.words ^= self.words >> np.uint64(29)
        self.words *= _M3
        self.words ^= self.words >> np.uint64(32)
        at = np.arange(self.n_windows)
        end = np.repeat(ends, np.diff(ends, prepend=0))[: self.n_windows]
        self.valid = (at + LENGTH <= end) & (at < own)
        self.anchor = self.anchors = np.zeros(0, np.int64)
        self.seg_start = self.seg_end = np.zeros(0, np.int64)
        self.segments = None
        if not self.valid.any():
            return
        # A gram's rank: the sum of scrambled words in it. It only chooses anchors.
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words, out=sums[1:])
        tagged = sums[GRAM - 7 :] - sums[: -(GRAM - 7)]
        mask = np.uint64((1 << _POSITION_BITS) - 1)
        tagged &= ~mask
        tagged |= np.arange(len(tagged), dtype=np.uint64)
        self.anchor = (_sliding_min(tagged, LENGTH - GRAM + 1) & mask).astype(np.int64)
        a = self.anchor[self.valid]
        new = np.diff(a, prepend=-1) != 0
        self.anchors = a[new]
        #: The place of each window's anchor among the anchors; 0 where the window is none.
        self.at = np.zeros(self.n_windows, np.int32)
        self.at[self.valid] = np.cumsum(new, dtype=np.int32) - 1
        self.anchor_keys = self.keys(self.anchors, GRAM)
        # From each anchor to the first one that makes the segment long enough, inside one text.
        to = np.searchsorted(self.anchors, self.anchors + LENGTH - GRAM)
        has = to < len(self.anchors)
        start, stop = self.anchors[has], self.anchors[to[has]] + GRAM
        inside = (np.searchsorted(ends, start, "right") == np.searchsorted(ends, stop - 1, "right")) & (start < own)
        self.seg_start, self.seg_end = start[inside], stop[inside]

    def keys(self, start: np.ndarray, length: int) -> np.ndarray:
        """(key, second hash) of the strings of ``length`` bytes, a multiple of ``STEP``, from each start on.

        A string is hashed in steps of ``STEP`` bytes, and these hashes are hashed again. Where
        many strings are asked for, the steps at all places are made once.
        """
        many = len(start) * length > 4 * len(self.words) and len(self.words) >= STEP
        steps = self._steps(slice(0, len(self.words) - STEP + 8)) if many else None
        one, two = np.full(len(start), length, np.uint64), np.full(len(start), _M3, np.uint64)
        for k in range(0, length, STEP):
            a, b = (x[start + k] for x in steps) if many else self._steps(start + k)
            one, two = _mixed(one, a, b, two)
        return np.column_stack([one, two])

    def _steps(self, start: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the ``STEP`` bytes from each place on."""
        at = lambda k: self.words[start.start + k : start.stop + k] if isinstance(start, slice) else self.words[start + k]
        first = at(0)
        one, two = np.full(len(first), STEP, np.uint64), np.full(len(first), _M2, np.uint64)
        for k in range(0, STEP, 8):
            w = first if k == 0 else at(k)
            one, two = _mixed(one, w, w, two)
        return one, two

    def segment_keys(self) -> np.ndarray:
        if self.segments is None:
            # No segment is longer than two windows, so these two cover it.
            length = (self.seg_end - self.seg_start).astype(np.uint64)[:, None]
            self.segments = K.mix(self.keys(self.seg_start, LENGTH) * _M3 + self.keys(self.seg_end - LENGTH, LENGTH) + length)
        return self.segments


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Slice]]:
    """(first row, byte where it starts, slice) over all rows; long rows in overlapping parts."""
    for a, b in K.row_chunks(offsets, SLICE_BYTES):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b == a + 1 and hi - lo > 4 * SLICE_BYTES:
            for s in range(lo, hi, SLICE_BYTES):
                e = min(s + SLICE_BYTES + 3 * LENGTH, hi)
                yield a, s, Slice(data[s:e], np.array([e - s]), SLICE_BYTES)
        else:
            yield a, lo, Slice(data[lo:hi], offsets[a + 1 : b + 1] - lo, hi - lo)


def _twice(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct (key, second hash) by key, and the keys that occur at least twice."""
    both = np.concatenate(keys) if keys else np.zeros((0, 2), np.uint64)
    order = np.argsort(both[:, 0])  # equal keys have equal second hashes, in any order
    key = both[order, 0]
    same = key[1:] == key[:-1]
    first = np.concatenate([np.ones(min(len(key), 1), bool), ~same])
    again = np.append(same, False)[: len(key)]
    return both[order[first]], key[first & again]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Deal:
    """Sorted keys as they are dealt to buckets."""

    def __init__(self, keys: np.ndarray, buckets: int):
        bucket = ((keys[:, 1] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.order = np.argsort(bucket, kind="stable")
        self.keys = keys[self.order, 0]
        self.buckets, first = np.unique(bucket[self.order].astype(np.int64), return_index=True)
        self.cuts = np.append(first, len(keys))

    def part(self, bucket: int) -> np.ndarray:
        k = int(np.searchsorted(self.buckets, bucket))
        return self.keys[self.cuts[k] : self.cuts[k + 1]]

    def rows(self, block: int, kind: int, places: np.ndarray | None = None) -> pa.Table:
        """One packed row per bucket: keys, then their places if given."""
        places = None if places is None else places[self.order]
        packed = [self.keys[i:j].tobytes() + (b"" if places is None else places[i:j].tobytes()) for i, j in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        n = len(packed)
        return pa.table({"bucket": pa.array(self.buckets, pa.int64()), "block": pa.array([block] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "keys": pa.array(packed, pa.binary())})


DEALT = "bucket long, block long, kind int, keys binary"
#: For each packed row that a block sent to a bucket, a bit per key; kind 3 also has places of the keys that are set.
SHARED = "block long, kind int, bucket long, bits binary"


def _first_keys(buckets: int):
    def keys(texts: pa.Table) -> pa.Table:
        data, offsets = K.utf8(texts.column("text"))
        found = [k for _, _, s in slices(data, offsets) if len(s.anchors) for k in (s.anchor_keys, s.segment_keys())]
        return Deal(_twice(found)[0], buckets).rows(texts.column("block")[0].as_py(), 1)

    return keys


def _meet(rows: pa.Table) -> pa.Table:
    """Which keys of a bucket at least two blocks have; as kind 4, of which of these a block is the first."""
    if not len(rows):
        return _shared_rows([])
    rows = rows.sort_by("block")  # the first block is the same one whenever this runs
    kind = rows.column("kind")[0].as_py()
    packed = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
    keys = np.concatenate(packed)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared, first = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    first[order[np.concatenate([[True], ~same])]] = True
    cuts = np.cumsum([0, *map(len, packed)])
    out = []
    for block, bucket, a, b in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), cuts[:-1], cuts[1:], strict=True):
        for k, flags in ((kind, shared[a:b]), *([(4, (shared & first)[a:b])] if kind == 1 else [])):
            if flags.any():
                out.append((block, k, bucket, np.packbits(flags).tobytes()))
    return _shared_rows(out)


def _shared_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["block", "kind", "bucket", "bits"])


def _told(shared: pa.Table, kind: int, sent: Deal) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys that this block sent, those that came back for a kind, sorted, and their places if it has any."""
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for k, bucket, bits in zip(*(shared.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True):
        if k == kind:
            part = sent.part(bucket)
            n = -(-len(part) // 8)
            keys.append(part[np.unpackbits(np.frombuffer(bits, np.uint8, n), count=len(part)).astype(bool)])
            places.append(np.frombuffer(bits, np.uint16, (len(bits) - n) // 2, n))
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    return key[order], place[order] if len(place) else place


class Block:
    """The texts of a block, its first keys and what came back for them."""

    def __init__(self, texts: pa.Table, shared: pa.Table, buckets: int):
        self.data, self.offsets = K.utf8(texts.column("text"))
        self.parts = list(slices(self.data, self.offsets))
        sent, own_twice = _twice([k for _, _, s in self.parts if len(s.anchors) for k in (s.anchor_keys, s.segment_keys())])
        sent = Deal(sent, buckets)
        elsewhere, spoken = (_told(shared, k, sent)[0] for k in (1, 4))
        self.announced = _told(shared, 3, sent)
        self.settled = _settled(self.parts, elsewhere, spoken, own_twice)

    def window_keys(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each slice the windows whose keys are compared, and these keys."""
        windows = _chosen(self.parts, self.settled, *self.announced)
        return windows, [s.keys(w, LENGTH) for (_, _, s), w in zip(self.parts, windows, strict=True)]


def _settled(parts: list[tuple[int, int, Slice]], shared: np.ndarray, spoken: np.ndarray, own_twice: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: windows known to repeat, those that may, those this block speaks for, and the place of each window's anchor."""

    def inside(s: Slice, hit: np.ndarray) -> np.ndarray:
        if not hit.any():
            return np.zeros(s.n_windows, bool)
        n = s.n_windows + 1
        change = np.bincount(s.seg_start[hit], minlength=n)[:n] - np.bincount(s.seg_end[hit] - LENGTH + 1, minlength=n)[:n]
        return (np.cumsum(change)[:-1] > 0) & s.valid

    out = []
    for _, _, s in parts:
        sure, open_, speaks, at = (np.zeros(s.n_windows, t) for t in (bool, bool, bool, np.int32))
        if len(s.anchors):
            k = s.segment_keys()[:, 0]
            elsewhere, here = _among(k, shared), _among(k, own_twice)
            sure = inside(s, elsewhere | here)
            speaks = inside(s, _among(k, spoken) | (here & ~elsewhere))
            own = s.anchor_keys[:, 0]
            again = _among(own, shared) | _among(own, own_twice)
            at = s.at
            open_ = s.valid & ~sure & again[at]
        out.append((sure, open_, speaks, at))
    return out


def _places(s: Slice, w: np.ndarray) -> np.ndarray:
    """For windows, one of 16 bits for where in its window the anchor lies."""
    return np.left_shift(1, np.clip((s.anchor[w] - w) * 16 // (LENGTH - GRAM + 1), 0, 15)).astype(np.uint16)


def _merge_places(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows by their first column, with all bits of each."""
    if not len(keys):
        return keys, bits
    order = np.argsort(keys[:, 0], kind="stable")
    keys, bits = keys[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]]))
    return keys[first], np.bitwise_or.reduceat(bits, first)


def _with_places(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of eight bytes, then as many pairs of bytes."""
    n = len(packed) // 10
    return np.frombuffer(packed, np.uint64, n), np.frombuffer(packed, np.uint16, n, 8 * n)


def _open_keys(buckets: int):
    def keys(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(texts):
            return Deal(np.zeros((0, 2), np.uint64), buckets).rows(0, 3)
        own = Block(texts, shared, buckets)
        found = [(s.anchor_keys[at[open_]], _places(s, np.flatnonzero(open_))) for (_, _, s), (_, open_, _, at) in zip(own.parts, own.settled, strict=True) if open_.any()]
        key, bits = _merge_places(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros((0, 2), np.uint64), np.zeros(0, np.uint16))
        return Deal(key, buckets).rows(texts.column("block")[0].as_py(), 3, bits)

    return keys


def _announce(first: pa.Table, open_: pa.Table) -> pa.Table:
    """Of the keys of each block in a bucket, those that some block has open, and where."""
    wanted = [_with_places(x) for x in open_.column("keys").to_pylist()]
    if not wanted:
        return _shared_rows([])
    wanted, places = (np.concatenate(x) for x in zip(*wanted, strict=True))
    wanted, places = _merge_places(wanted[:, None], places)
    wanted = wanted[:, 0]
    rows = []
    for block, bucket, packed in zip(*(first.column(k).to_pylist() for k in ("block", "bucket", "keys")), strict=True):
        keys = np.frombuffer(packed, np.uint64)
        hit = _among(keys, wanted)
        if hit.any():
            rows.append((block, 3, bucket, np.packbits(hit).tobytes() + places[np.searchsorted(wanted, keys[hit])].tobytes()))
    return _shared_rows(rows)


def _chosen(parts, settled, known: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Windows whose keys are compared: unsettled ones, and announced ones this block speaks for."""
    out = []
    for (_, _, s), (_, open_, speaks, anchor) in zip(parts, settled, strict=True):
        pick = open_.copy()
        w = np.flatnonzero(speaks & ~open_)
        if len(w) and len(known):
            key = s.anchor_keys[anchor[w], 0]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            pick[w[(known[at] == key) & ((places[at] & _places(s, w)) > 0)]] = True
        out.append(np.flatnonzero(pick))
    return out


def _rest_keys(buckets: int):
    def keys(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(texts):
            return Deal(np.zeros((0, 2), np.uint64), buckets).rows(0, 2)
        sent = _twice(Block(texts, shared, buckets).window_keys()[1])[0]
        return Deal(sent, buckets).rows(texts.column("block")[0].as_py(), 2)

    return keys


#: What the operator returns besides the columns it carries; spans are byte ranges, end exclusive.
RESULT = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _remover(buckets: int):
    def remove(texts: pa.Table, shared: pa.Table) -> pa.Table:
        return _cut(texts, shared, buckets)

    return remove


def _cut(texts: pa.Table, shared: pa.Table, buckets: int) -> pa.Table:
    """Carried columns, size, removed spans and kept bytes of a block's texts."""
    own = Block(texts, shared, buckets)
    data, offsets = own.data, own.offsets
    windows, rest = own.window_keys()
    sent, twice = _twice(rest)
    known = _told(shared, 2, Deal(sent, buckets))[0]
    cover = np.zeros(len(data) + 1, np.int64)
    for (_, base, _), (sure, _, _, _), w, keys in zip(own.parts, own.settled, windows, rest, strict=True):
        again = w[_among(keys[:, 0], known) | _among(keys[:, 0], twice)]
        start = base + np.concatenate([np.flatnonzero(sure), again])
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
    gone = np.cumsum(cover)[:-1] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] |= gone[offsets[:-1][np.diff(offsets) > 0]]
    ends = gone.copy()
    ends[:-1] &= ~gone[1:] | begins[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = pa.array(np.searchsorted(start, offsets), pa.int32())
    base = offsets[np.searchsorted(offsets, start, "right") - 1]
    spans = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(stop - base, pa.int64())], ["start", "end"]))
    kept = pa.array([data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
    carried = {c: texts.column(c) for c in texts.column_names if c not in ("text", "block")}
    return pa.table(carried | {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "spans": spans, "kept": kept})


def _remove(texts: pa.Table, shared: pa.Table, buckets: int) -> pa.Table:
    """The digest of a block, as ``substring_digest`` has it."""
    cut = _cut(texts, shared, buckets)
    spans = cut.column("spans").to_pylist()
    sha = [hashlib.sha256(x).hexdigest() for x in cut.column("kept").to_pylist()]
    removed = [sum(s["end"] - s["start"] for s in x) for x in spans]
    return pa.table({"doc_id": cut.column("doc_id"), "n_bytes": cut.column("n_bytes"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def kept_text(kept: Column) -> Column:
    """Kept bytes as text; what is left of a character that was cut through is U+FFFD."""
    return F.make_valid_utf8(kept.cast("string"))


def substring_digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from the operator's kept bytes and spans."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return substring_digest(remove_repeats(docs))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_bytes``, removed ``spans`` (bytes of the text) and ``kept`` bytes of every document.

    The columns to keep go with the texts through their exchange. A null text is empty. Texts shorter than ``LENGTH`` bytes lose nothing. Repeated rows
    are documents of their own, so each removes the other; rows equal in text and kept columns
    share a block. Null and repeated ids are reported as they are. An empty table gives an
    empty result; other columns are ignored. A very long text is walked in slices but held
    whole by its block.
    """
    spark = docs.sparkSession
    size = total_bytes(docs, "text")
    n_blocks = max(64, -(-size // BLOCK_BYTES))
    buckets = max(64, -(-size * 16 // ((LENGTH - GRAM) // 2) // BUCKET_BYTES))
    hashed = [c for c in keep if not isinstance(docs.schema[c].dataType, MapType)]
    block = F.pmod(F.xxhash64(*hashed, "text"), F.lit(n_blocks))
    partitions = max(-(-size // TASK_BYTES), min(n_blocks, spark.sparkContext.defaultParallelism))
    texts = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"), block.alias("block")).repartition(partitions, "block")
    first = texts.groupBy("block").applyInArrow(_first_keys(buckets), DEALT)
    shared = first.groupBy("bucket").applyInArrow(_meet, SHARED)
    open_ = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_open_keys(buckets), DEALT)
    told = shared.unionByName(first.groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(_announce, SHARED))
    rest = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_rest_keys(buckets), DEALT)
    both = told.unionByName(rest.groupBy("bucket").applyInArrow(_meet, SHARED))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.schema.fields[: len(keep)])
    out = texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_remover(buckets), fields + RESULT)
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", "kept")
