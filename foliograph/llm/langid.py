"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (one to three characters, letters lower-cased, everything else
one blank) of all labelled training texts in hash buckets; the counts of all tasks are
summed by Spark. The matrix of log probabilities has ``BUCKETS`` rows and a column per
language, a size fixed by the label set, and is broadcast. Scoring gathers matrix rows
for the n-grams of a batch and sums them by text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: The matrix is broadcast; more labels than this are no languages.
MAX_LABELS = 1000
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    if not _tables:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram sorted by row, and the number of letters of each row."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    index = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = index[offsets]
    c = _fold()[points].astype(np.uint64)
    row = K.segment_rows(first)
    letters = np.bincount(row[c != 32], minlength=len(offsets) - 1)
    buckets, rows = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)) if n > 1 else c + np.uint64(1)
        if not len(h):
            break
        if n in ORDERS:
            inside = row[: len(h)] == row[n - 1 :]
            buckets.append((K.mix(h[inside].copy()) >> np.uint64(64 - 15)).astype(np.int64))
            rows.append(row[: len(h)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    rows_all = np.concatenate(rows)
    order = np.argsort(rows_all, kind="stable")
    return np.concatenate(buckets)[order], rows_all[order], letters


def _trainer(labels: list[str]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(labels)}
        total = np.zeros(len(labels) * BUCKETS, np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = K.utf8(batch.column(0))
            for a, b in K.row_chunks(offsets):
                base = offsets[a]
                bucket, row, _ = gram_buckets(data[base : offsets[b]], offsets[a : b + 1] - base)
                total += np.bincount(lang[a + row] * BUCKETS + bucket, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    return train


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, the matrix of log probabilities and the log priors, from (text, lang) rows."""
    labelled = labelled.select("text", "lang").where(F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").count().limit(MAX_LABELS + 1).toPandas().sort_values("lang")
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = sizes["lang"].tolist()
    counts = np.zeros(len(labels) * BUCKETS)
    if labels:
        cells = labelled.mapInArrow(_trainer(labels), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
    counts = counts.reshape(len(labels), BUCKETS).T + SMOOTHING
    matrix = np.log(counts / counts.sum(axis=0))
    return labels, np.ascontiguousarray(matrix), np.log(sizes["count"].to_numpy(float) / max(sizes["count"].sum(), 1))


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix, prior = model.value
        for batch in batches:
            data, offsets = K.utf8(batch.column(batch.num_columns - 1))
            said, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b in K.row_chunks(offsets):
                base = offsets[a]
                bucket, row, letters = gram_buckets(data[base : offsets[b]], offsets[a : b + 1] - base)
                if not labels or not len(bucket):
                    continue
                total = np.tile(prior, (b - a, 1))
                start = np.flatnonzero(np.diff(row, prepend=-1))
                for k in range(len(labels)):
                    total[row[start], k] += np.add.reduceat(matrix[:, k][bucket], start)
                best = total.argmax(axis=1)
                p = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(letters):
                    said[a + i], sure[a + i] = labels[best[i]], p[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said), pa.array(sure)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``, the posterior of the prediction.

    Only the text is looked at. A null text, a text without a letter and any text under a
    model without labels gets ``und`` and 0. Ties go to the label that sorts first. A very
    long text is scored whole, with arrays of some dozen times its size.
    Repeated rows give repeated results, an empty table an empty one; other columns are
    ignored.
    """
    slim = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = slim.mapInArrow(_scorer(shared), f"{fields}, lang_pred string, score double")
    return scored.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identify_languages(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
