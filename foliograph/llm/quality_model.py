"""Quality classifier by co-training of two views.

One logistic model sees the text's content (hashed words and shape measures), the other
the page's metadata (source, language, length, layout of lines). Over a few rounds each
labels the unlabelled documents of which it is sure, for the other to learn from. Both
are calibrated on labelled documents kept aside, and a last logistic model over the two
calibrated logits combines them.

Labelled documents are a sample of ``MAX_LABELLED``, chosen by a hash of the id. All
unlabelled documents take part: their features are written once, and each Newton step
labels them in the executors and adds up gradients and Hessians there, so that the driver
gets sums of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, scratch_scope
from .line_rules import measure

MAX_LABELLED = 8_000
ROUNDS = 4
#: A pseudo-label is exchanged where the model is at least this sure.
CONFIDENT = 0.97
#: A fit over the corpus ends where another Newton step would gain less than this share of the loss, or after so many.
GAIN, STEPS = 1e-4, 12
#: Pieces in which sums are added up, and rows of features taken at once.
PIECES, ROWS = 16, 2048
#: Documents with a combined score below this are rejected.
THRESHOLD = 0.35
WORD_SLOTS = 512
NAME_SLOTS = 64
#: Share of the labelled sample kept aside for calibration: one in this many.
ASIDE = 4

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The content view of each text, and its layout (part of the metadata view)."""
    n = len(offsets) - 1
    m = measure(data, offsets, normalised=False)
    row = m["word_row"]
    words = K.word_hashes(data, m["starts"], m["ends"])
    slots = np.bincount(row * WORD_SLOTS + (words >> np.uint64(55)).astype(np.int64), minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
    slots = np.sqrt(slots)
    slots /= np.maximum(np.linalg.norm(slots, axis=1, keepdims=True), 1)
    count, size = np.maximum(m["n_words"], 1), np.maximum(np.diff(offsets), 1)
    distinct = K.first_of_each(K.mix(words + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shape = np.column_stack([
        m["n_symbols"] / count,
        *(m["bytes"][:, kind].sum(axis=1) / size for kind in (_UPPER, _DIGIT, _PUNCT)),
        m["bytes"][:, 33] / size,
        m["bytes"][:, 124] / size,
        np.bincount(row[distinct], minlength=n) / count,
        m["word_chars"] / count,
        m["n_repeat_words"] / count,
        np.bincount(row[again], minlength=n) / count,
    ])
    lines = m["bytes"][:, 10] + 1
    layout = np.column_stack([np.log1p(m["n_words"]), np.log1p(lines), np.log1p(np.diff(offsets) / lines), m["n_dup_lines"] / lines])
    return np.hstack([shape, slots]).astype(np.float32), layout


def _name_slot(names: list, salt: int) -> np.ndarray:
    out = np.zeros((len(names), NAME_SLOTS), np.float32)
    for i, x in enumerate(names):
        h = 1469598103934665603 + salt
        for b in ("\0" if x is None else str(x)).encode():
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        out[i, (h >> 32) % NAME_SLOTS] = 1
    return out


def features(batch_text: pa.Array, lang: list, source: list, n_chars: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, content view, metadata view) for stretches of a batch."""
    data, offsets = K.utf8(batch_text)
    for a, b in K.row_chunks(offsets):
        base = offsets[a]
        content, layout = text_features(data[base : offsets[b]], offsets[a : b + 1] - base)
        length = np.array([0.0 if x is None or x < 0 else np.log1p(x) for x in n_chars[a:b]])
        meta = np.hstack([layout, length[:, None], _name_slot(lang[a:b], 1), _name_slot(source[a:b], 2)]).astype(np.float32)
        yield a, b, content, meta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        """Newton's method with a ridge penalty; deterministic."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-6, scale, np.inf)
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = _sigmoid(z @ w)
            grad = z.T @ (p - y) + penalty * w
            hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale.logit(self.text.logit(content)[:, None])
        b = self.meta_scale.logit(self.meta.logit(meta)[:, None])
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both.logit(np.column_stack([a, b])))


@dataclass
class Teacher:
    """A view as it stood in a round: its calibrated model, which labels for the other view."""

    model: Logistic
    scale: Logistic


class Teachers:
    """All rounds of a view: on raw features each is one product, with the standardisation in its weights."""

    def __init__(self, teachers: list[Teacher]):
        d = len(teachers[0].model.weights)
        self.weights, shift = np.zeros((d, len(teachers)), np.float32), []
        for k, t in enumerate(teachers):
            slope = float(t.scale.weights[0] / t.scale.scale[0])
            w = t.model.weights / t.model.scale
            self.weights[:, k] = w * slope
            shift.append((t.model.bias - float(t.model.mean @ w) - float(t.scale.mean[0])) * slope + t.scale.bias)
        self.shift = np.array(shift)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The label of each row by the first round that was sure of it, NaN where none was."""
        p = _sigmoid(x @ self.weights + self.shift)
        sure = np.maximum(p, 1 - p) >= CONFIDENT
        first = sure.argmax(axis=1)
        rows = np.arange(len(x))
        return np.where(sure[rows, first], (p[rows, first] > 0.5).astype(float), np.nan)


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian for standardised features, from raw rows, one after the other."""
    inverse = 1 / scale  # 0 for constant features
    v = w[:-1] * inverse
    at = np.clip((x @ v.astype(np.float32)).astype(np.float64) + (w[-1] - float(mean @ v)), -35, 35)
    p = _sigmoid(at)
    rest = p - y
    raw = (x.T @ rest.astype(np.float32)).astype(np.float64)
    grad = np.append((raw - mean * rest.sum()) * inverse, rest.sum())
    curve = np.maximum(p * (1 - p), 1e-6)
    c32 = curve.astype(np.float32)
    square, side, total = ((x * c32[:, None]).T @ x).astype(np.float64), (x.T @ c32).astype(np.float64), curve.sum()
    square += total * np.outer(mean, mean) - np.outer(mean, side) - np.outer(side, mean)
    hess = np.empty((len(w), len(w)))
    hess[:-1, :-1] = square * np.outer(inverse, inverse)
    hess[-1, :-1] = hess[:-1, -1] = (side - mean * total) * inverse
    hess[-1, -1] = total
    return np.concatenate([[np.sum(np.logaddexp(0, at) - y * at)], grad, hess.ravel()])


VIEWS = ("text", "meta")
OTHER = {"text": "meta", "meta": "text"}


def _features(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for a in range(0, batch.num_rows, ROWS):
        part = batch.slice(a, ROWS)
        yield {k: np.frombuffer(b"".join(part.column(i).to_pylist()), np.float32).reshape(part.num_rows, -1) for i, k in enumerate(VIEWS)}


#: Partial sums that are added up in one group at most.
FAN_IN = 64


def _added(rows: DataFrame, tasks: int) -> DataFrame:
    """(piece, task, v) added up by piece, at most ``FAN_IN`` of them at a time, so that no group grows with the number of tasks."""

    def add(rows: pa.Table) -> pa.Table:
        # In the order of tasks: rounding does not depend on which came first.
        rows = rows.sort_by("task")
        v = sum(np.frombuffer(x, np.float64) for x in rows.column("v").to_pylist())
        return pa.table({"piece": rows.column("piece").slice(0, 1), "task": rows.column("task").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    width = 1
    while True:
        width *= FAN_IN
        rows = rows.groupBy("piece", F.expr(f"task div {width}")).applyInArrow(lambda key, rows: add(rows), "piece int, task int, v binary")
        if width >= tasks:
            return rows


@dataclass
class Pool:
    """Stored features (content, meta) of the unlabelled documents, and how many tasks read them."""

    rows: DataFrame
    tasks: int


def _summed(pool: Pool, sums) -> np.ndarray | None:
    """``sums(features)`` added up over all rows in the executors; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for x in _features(batch):
                v = sums(x)
                total = v if total is None else total + v
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int32()), pa.array([v.tobytes() for v in np.array_split(total, PIECES)], pa.binary())], ["piece", "task", "v"])

    got = _added(pool.rows.mapInArrow(partial, "piece int, task int, v binary"), pool.tasks).collect()
    return np.concatenate([np.frombuffer(r.v, np.float64) for r in sorted(got, key=lambda r: r.piece)]) if got else None


def _in_parts(x: dict[str, np.ndarray], sums) -> np.ndarray:
    """``sums(features, from, to)`` over the driver's rows, a part at a time as in the executors."""
    n = len(x["text"])
    return sum(sums({k: v[a : a + ROWS] for k, v in x.items()}, a, min(a + ROWS, n)) for a in range(0, n, ROWS))


def _moments(x: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([[len(x["text"])], *[f(x[k].astype(np.float64)) for k in VIEWS for f in (lambda v: v.sum(axis=0), lambda v: np.square(v).sum(axis=0))]])


def _standard(x: dict[str, np.ndarray], pool: Pool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of each view's features over the given labelled rows and the whole pool."""
    total = _in_parts(x, lambda part, a, b: _moments(part))
    rest = _summed(pool, _moments)
    total = total if rest is None else total + rest
    out, at = {}, 1
    for k in VIEWS:
        d = x[k].shape[1]
        mean, square = total[at : at + d] / total[0], total[at + d : at + 2 * d] / total[0]
        scale = np.sqrt(np.maximum(square - mean**2, 0))
        out[k], at = (mean, np.where(scale > 1e-6, scale, np.inf)), at + 2 * d
    return out


def _pool_sums(standard: dict, teachers: dict[str, Teachers], weights: dict[str, np.ndarray]):
    """Sums of the pool's rows for the views in ``weights``, by the labels of the other view."""

    def sums(x: dict[str, np.ndarray]) -> np.ndarray:
        out = []
        for k, w in weights.items():
            y = teachers[OTHER[k]].labels(x[OTHER[k]])
            has = ~np.isnan(y)
            out.append(logistic_sums(x[k][has], y[has], w, *standard[k]))
        return np.concatenate(out)

    return sums


def _fit_views(x: dict[str, np.ndarray], y: np.ndarray, pool: Pool | None, standard: dict, teachers: dict[str, list[Teacher]], weights: dict[str, np.ndarray], ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Newton's method for both views at once over labelled rows and, if given, the taught pool."""
    now, best, done = dict(weights), {}, {}
    folded = {k: Teachers(t) for k, t in teachers.items() if t}
    for _ in range(STEPS):
        rest = _summed(pool, _pool_sums(standard, folded, now)) if pool is not None else None
        at = 0
        for k, w in list(now.items()):
            d = len(w)
            n = 1 + d + d * d
            total = _in_parts(x, lambda part, a, b, k=k, w=w: logistic_sums(part[k], y[a:b], w, *standard[k])) + (0 if rest is None else rest[at : at + n])
            at += n
            penalty = np.append(np.full(d - 1, ridge), 1e-6)
            loss = total[0] + 0.5 * float(penalty @ (w * w))
            if k in best and loss > best[k][0]:  # a step too far: half of it
                now[k] = (w + best[k][1]) / 2
                continue
            grad, hess = total[1 : 1 + d] + penalty * w, total[1 + d :].reshape(d, d) + np.diag(penalty)
            best[k] = (loss, w)
            step = np.linalg.solve(hess, grad)
            now[k] = w - step
            if float(grad @ step) / 2 < GAIN * (1 + loss):
                done[k] = now.pop(k)
        if not now:
            break
    return {k: done[k] if k in done else best[k][1] for k in weights}


def co_train(views: dict[str, np.ndarray], y: np.ndarray, pool: Pool) -> Model | None:
    """Fit both views and their combination; None unless both labels occur on either side of the split."""
    aside = np.arange(len(y)) % ASIDE == 0
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        return None
    train, held = ({k: views[k][m] for k in VIEWS} for m in (~aside, aside))
    views.clear()  # the driver holds the sample once
    standard = _standard(train, pool)
    teachers: dict[str, list[Teacher]] = {k: [] for k in VIEWS}
    weights = _fit_views(train, y[~aside], None, standard, teachers, {k: np.zeros(train[k].shape[1] + 1) for k in VIEWS})

    def calibrated(ridge: float) -> dict[str, Teacher]:
        models = {k: Logistic(*standard[k], weights[k][:-1], float(weights[k][-1])) for k in VIEWS}
        return {k: Teacher(m, Logistic.fit(m.logit(held[k])[:, None], y[aside], ridge=ridge)) for k, m in models.items()}

    for _ in range(ROUNDS):
        for k, t in calibrated(1e-3).items():
            teachers[k].append(t)
        weights = _fit_views(train, y[~aside], pool, standard, teachers, weights)
    last = calibrated(1e-2)
    both = np.column_stack([last[k].scale.logit(last[k].model.logit(held[k])[:, None]) for k in VIEWS])
    return Model(last["text"].model, last["meta"].model, last["text"].scale, last["meta"].scale, Logistic.fit(both, y[aside], ridge=1e-1))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carried columns, then text, lang, source, n_chars: the last four as features."""
    for batch in batches:
        kept = batch.num_columns - 4
        for a, b, content, meta in features(batch.column(kept), *(batch.column(kept + k).to_pylist() for k in (1, 2, 3))):
            rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (content, meta)]
            yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:kept]], *rows], [*batch.schema.names[:kept], "content", "meta"])


def _stored_features(docs: DataFrame, known: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(id, c0, c1 ..., content, meta, y) of every document, a stored table; y is null without a label."""
    slim = docs.select(F.col("doc_id").alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], "text", "lang", "source", "n_chars")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema.fields[: 1 + len(carry)])
    packed = slim.mapInArrow(_packed, fields + "content binary, meta binary")
    return materialize(packed.join(known, "id", "left"), "quality-features")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, carry: tuple[str, ...] = ()) -> tuple[Model | None, DataFrame]:
    """The co-trained model, and the stored features of all documents with the columns to carry."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("double").alias("y"))
    rows = _stored_features(docs, known, carry)
    labelled = rows.where("y is not null")
    # Bounded by the parameter, so it may be broadcast.
    chosen = F.broadcast(labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    one = labelled.join(chosen, "id").groupBy("id").agg(F.min(F.struct("content", "meta", "y")).alias("r"))
    got = one.select("id", "r.*").toPandas().sort_values("id", ignore_index=True)
    mixed = K.mix(got["id"].to_numpy(np.int64).astype(np.uint64))
    got = got.iloc[np.argsort(mixed, kind="stable")]
    views = {v: np.frombuffer(b"".join(got.pop(k)), np.float32).reshape(len(got), -1) if len(got) else np.zeros((0, 1), np.float32) for v, k in zip(VIEWS, ("content", "meta"), strict=True)}
    pool = rows.where("y is null").select("content", "meta")
    return co_train(views, got["y"].to_numpy(float), Pool(pool, pool.rdd.getNumPartitions())), rows


def _scores(model, content: np.ndarray, meta: np.ndarray) -> list[pa.Array]:
    s = model.value.scores(content, meta) if model.value is not None else (np.full(len(content), 0.5),) * 3
    return [pa.array(np.asarray(x, np.float64)) for x in s]


def _scorer(model, at: dict[str, int]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(at[k]) for k in ("text", "lang", "source", "n_chars")]
            for a, b, content, meta in features(columns[0], *(c.to_pylist() for c in columns[1:])):
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], *_scores(model, content, meta)], [*batch.schema.names, "s1", "s2", "s3"])

    return score


def _rescorer(model):
    """Scores of stored features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - 2
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = [np.frombuffer(b"".join(part.column(kept + k).to_pylist()), np.float32).reshape(part.num_rows, -1) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *_scores(model, *x)], [*batch.schema.names[:kept], "s1", "s2", "s3"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The ``carry`` columns with ``score_text``, ``score_meta``, ``score`` and ``kept``.

    Scores are probabilities of quality 1. Null texts are empty ones, null metadata values
    a value of their own. Labels with a null id or quality and labels of other documents
    are ignored; of several labels of an id the lowest counts, of several documents of a
    labelled id one is learned from, and rows of one id that are equal in features are one. Equal scores are equal verdicts: nothing is
    ranked. All documents are scored, repeated ones each; a very long
    text is measured whole. Without labels of both kinds every score is 0.5 and everything is
    kept. Columns that are not named are ignored. An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    names = [f"c{i}" for i in range(len(carry))]
    with scratch_scope(docs.sparkSession) as keep:
        # Without texts to carry, documents are scored from the features that are there already.
        stored = "text" not in carry
        model, rows = fit(docs, labels, carry=carry if stored else ())
        if stored:
            keep.append(rows)
            slim = rows.select(*names, "content", "meta")
            scorer = _rescorer(sc.broadcast(model))
            kept = slim.schema.fields[:-2]
        else:
            carried = list(dict.fromkeys([*carry, "text", "lang", "source", "n_chars"]))
            slim = docs.select(*carried).toDF(*[f"c{i}" for i in range(len(carried))])
            scorer = _scorer(sc.broadcast(model), {c: i for i, c in enumerate(carried)})
            kept = slim.schema.fields
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)
    scored = slim.mapInArrow(scorer, f"{fields}s1 double, s2 double, s3 double")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("s1").alias("score_text"), F.col("s2").alias("score_meta"), F.col("s3").alias("score"), (F.col("s3") >= threshold).alias("kept"))
