"""numpy kernels over the bytes of Arrow string columns: words, hashes, shingles.

All of them work on UTF-8 bytes: every word class used here is a class of bytes, since
bytes of 0x80 and over only occur in code points beyond ASCII.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; temporary arrays are a few dozen times as large.
CHUNK_BYTES = 1 << 19


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Not white space (0x20, 0x09 to 0x0D).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: 0-9, a-z and everything beyond ASCII, once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER_CODES = _BYTE_CODES[lower_table()]
#: Longest stretch hashed at once: longer ones are hashed in pieces of this many elements.
PIECE = 1 << 16
#: One odd factor for each place in a piece. Sums of codes times random factors do not
#: collide by construction, as powers of one base do modulo a power of two.
_FACTORS = _rng.integers(0, 1 << 64, PIECE, dtype=np.uint64) | np.uint64(1)
_LINK = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word crosses from one row into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = in_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0], edge[-1] = mask[0], mask[-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[mask[cut] & mask[cut - 1]]
    flips = np.flatnonzero(edge)
    if len(cut):
        flips = np.sort(np.concatenate([flips, cut, cut]))
    return flips[::2], flips[1::2]


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint ranges of ``codes``, by content and length."""
    out = np.zeros(len(starts), np.uint64)
    length = ends - starts
    if not len(starts) or not length.any():
        return mix(out)
    long = np.flatnonzero(length > PIECE)
    base = int(starts[0])
    n = int(ends[-1]) - base
    # The place of each element in its range, counted from the last start.
    start = starts[length > 0] - base
    step = np.ones(n, np.int64)
    step[0] = 0
    step[start[1:]] -= np.diff(start)
    place = np.cumsum(step)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[base : base + n] * _FACTORS.take(place, mode="clip"), out=sums[1:])
    out = sums[ends - base] - sums[starts - base]
    for i in long:
        h = 0
        for a in range(int(starts[i]), int(ends[i]), PIECE):
            part = codes[a : min(a + PIECE, int(ends[i]))]
            h = (h * int(_LINK) + int((part * _FACTORS[: len(part)]).sum())) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        out[i] = h
    return mix(out + length.astype(np.uint64) * _LINK)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word or line, in slices of about a piece that end where they do."""
    out = np.empty(len(starts), np.uint64)
    codes = _LOWER_CODES if lower else _BYTE_CODES
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + PIECE, "right")), first + 1)
        s, e = starts[first:last] - base, ends[first:last] - base
        if e[0] > PIECE:
            out[first] = _long_hash(data, base, int(ends[first]), codes)
        else:
            out[first:last] = range_hashes(codes.take(data[base : int(ends[last - 1])]), s, e)
        first = last
    return out


def _long_hash(data: np.ndarray, start: int, end: int, codes: np.ndarray) -> np.uint64:
    """``range_hashes`` of one range longer than a piece, a piece at a time."""
    h = 0
    for a in range(start, end, PIECE):
        part = codes[data[a : min(a + PIECE, end)]]
        h = (h * int(_LINK) + int((part * _FACTORS[: len(part)]).sum())) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return mix(np.array([h], np.uint64) + np.array([end - start], np.uint64) * _LINK)[0]


def doc_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the index of each row's first word (one more than rows)."""
    starts, ends = find_words(data, offsets, in_word)
    return starts, ends, word_hashes(data, starts, ends, lower), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of q consecutive words, regardless of rows; q - 1 fewer than words."""
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, q, np.uint64)
    for k in range(q):
        out *= _LINK
        out += words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte occurs in each row: (rows, 256)."""
    return np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, 256)


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """The index of one occurrence of each distinct key."""
    order = np.argsort(keys)
    key = keys[order]
    return order[np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])]


def segment_rows(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the index of each row's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
