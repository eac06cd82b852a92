"""Token counts: batch encoding inside Arrow functions that returns lengths only.

A text is cut at ASCII white space. The tokenizer drops white space, its normalizer does
not join characters across it and no special string holds any, so the counts of the pieces
add up to the count of the text. Distinct pieces are encoded once for a stretch of
texts, in batches balanced by bytes, and the lengths of short ones are remembered in a table
of bounded size that starts anew when full. Long texts are walked in slices that end at
white space or, in a stretch without any, where the tokenizer cuts in any case: between two
ASCII characters of different kinds or two digits, outside of special strings. So memory follows
the slice and not the text, but for stretches of letters only (or beyond ASCII) without a
cut, which are one word to the tokenizer and go to it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text walked at once, bytes of pieces in one call, pieces remembered.
SLICE_BYTES = 1 << 18
BATCH_BYTES = 1 << 16
REMEMBERED, REMEMBERED_BYTES = 400_000, 256
# Kinds of ASCII characters between which a word ends: letters, digits, others. 0: no cut beside it.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_APOSTROPHE = 39

_loaded: dict = {}


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(text: np.ndarray, start: int, special: list[bytes]) -> int:
    """The first place from ``start`` on where the text may be cut, or its end."""
    while start < len(text):
        part = text[start - 1 : start + SLICE_BYTES]
        left, right = part[:-1], part[1:]
        a, b = _KIND[left], _KIND[right]
        ok = (a > 0) & (b > 0) & ((a != b) | (a == 2)) & ~((left == _APOSTROPHE) & (b == 1))
        ok |= ~K.NOT_SPACE[right]
        for at in np.flatnonzero(ok):
            i = start + int(at)
            if not any((near := text[max(i - len(x) + 1, 0) : i + len(x) - 1].tobytes()) and x in near for x in special):
                return i
        start += SLICE_BYTES
    return len(text)


def _slices(text: np.ndarray, special: list[bytes] = []) -> Iterator[bytes]:  # noqa: B006
    """The bytes of a text in slices at whose ends the tokenizer cuts."""
    start = 0
    while start < len(text):
        end = _cut(text, start + SLICE_BYTES, special) if start + SLICE_BYTES < len(text) else len(text)
        yield text[start:end].tobytes()
        start = end


class Counter:
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_str(definition)
        self.encode.no_truncation()
        self.encode.no_padding()
        self.special = [x.content.encode() for x in self.encode.get_added_tokens_decoder().values()]
        self.known: dict[bytes, int] = {}

    def lengths(self, pieces: list[bytes]) -> Iterator[tuple[bytes, int]]:
        batch, size = [], 0
        for i, piece in enumerate(pieces):
            batch.append(piece)
            size += len(piece)
            if size >= BATCH_BYTES or i + 1 == len(pieces):
                encoded = self.encode.encode_batch_fast([x.decode() for x in batch], add_special_tokens=False)
                yield from zip(batch, map(len, encoded), strict=True)
                batch, size = [], 0

    def count(self, texts: list[list[bytes]]) -> list[int]:
        pieces = {x for pieces in texts for x in pieces}
        new = [x for x in pieces if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        self.known.update(self.lengths(new))
        known = self.known
        counts = [sum(map(known.__getitem__, pieces)) for pieces in texts]
        for x in new:
            if len(x) > REMEMBERED_BYTES:
                del known[x]
        return counts


def _counter(definition):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(definition.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Counter(definition.value)
        counter = _loaded[key]
        for batch in batches:
            data, offsets = K.utf8(batch.column(batch.num_columns - 1))
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in K.row_chunks(offsets, SLICE_BYTES):
                if b == a + 1 and offsets[b] - offsets[a] > SLICE_BYTES:
                    n_tokens[a] = sum(counter.count([piece.split()])[0] for piece in _slices(data[offsets[a] : offsets[b]], counter.special))
                else:
                    n_tokens[a:b] = counter.count([data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(a, b)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(n_tokens)], [*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The ``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` is a tokenizers file on the driver; its text goes to the executors, which
    need no such file. The cutting relies on a tokenizer that drops white space, as the
    default one does, and cuts as its patterns do. Null and empty texts have no bytes and no tokens. Rows are handled
    one by one: repeated rows give repeated results, an empty table an empty one. Columns
    that are not named are ignored.
    """
    with open(path or tokenizer_file(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    counted = slim.mapInArrow(_counter(definition), f"{fields}, n_bytes long, n_tokens long")
    return counted.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
