"""Quality scores by co-training.

Two views of a document have a naive Bayes model each: its text (hashed byte trigrams of the whole text) and its page
metadata (source, language, and the size that the page's row states). In each round all documents without a label are
scored by both views, and those that one view is sure of (a calibrated probability of ``sure`` or more, for either
class) are examples of that class for the *other* view. A fold of the labels that neither trains on calibrates each
view, and a small model joins the calibrated views. Scoring every document is one pass without a shuffle.

A naive Bayes model is sums of features by class. So the pseudo-labels of a round, however many, come as sums from the
tasks, and the driver holds two tables of fixed size. Only the labelled rows are bounded: ``max_labelled``, those of
least hash of the id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, small, stored
from lodeworks.llm.textops import pieces, tidy

BUCKETS = 1 << 14
META = 1 << 10


def text_features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and weights: log counts of byte trigrams, to unit length."""
    for a, b, raw, off in pieces(col):
        wide = raw.astype(np.uint32)
        tri = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16 if len(raw) > 2 else np.zeros(0, np.uint32)
        tri = (tri * np.uint32(2654435761)) >> np.uint32(18)
        for i in range(b - a):
            own = tri[off[i] : max(off[i], off[i + 1] - 2)]
            n = np.bincount(own, minlength=BUCKETS)
            on = np.flatnonzero(n)
            v = np.log1p(n[on]).astype(np.float32)
            yield on, v / max(float(np.sqrt((v * v).sum())), 1e-9)


def meta_features(source: pa.Array, lang: pa.Array, chars: pa.Array) -> np.ndarray:
    """Three buckets a row: source, language, power of two of the length (nulls have buckets of their own)."""

    def bucket(col: pa.Array, tag: str) -> np.ndarray:
        code = col.cast(pa.string()).dictionary_encode()
        of = np.array([zlib.crc32(f"{tag}={x}".encode()) % (META - 80) + 80 for x in code.dictionary.to_pylist()] + [zlib.crc32(tag.encode()) % (META - 80) + 80])
        return of[code.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]

    n = chars.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    size = np.where(n < 0, 79, np.log2(np.maximum(n, 0) + 1.0).astype(int))
    return np.stack([bucket(source, "source"), bucket(lang, "lang"), size], 1)


@dataclass
class Rows:
    """Sparse rows: flat buckets and weights with the row of each."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, rounds: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias, by Adam on the weighted log loss."""
    w = np.zeros(x.width + 1) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    for t in range(1, rounds + 1):
        r = weight * (sigmoid(x.dot(w) + w[-1]) - y) / total
        g = np.r_[x.back(r) + ridge * w[:-1], r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a calibrated logit; the slope isn't negative.

    Targets are drawn in from 0 and 1 by the classes' sizes, so that classes a score parts cleanly don't drive the slope
    to infinity, and scores are brought to unit spread first.
    """
    spread = max(float(z.std()), 1e-9)
    x = z / spread
    high, low = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: float(np.logaddexp(0, a * x + b).sum() - (t * (a * x + b)).sum() + 5e-4 * a * a)
    for _ in range(100):
        p = sigmoid(a * x + b)
        d = p * (1 - p) + 1e-6
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(d * x * x).sum() + 1e-3, (d * x).sum()], [(d * x).sum(), d.sum()]])
        step, now, size = np.linalg.solve(h, g), loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(a), 0.0) / spread, float(b)


@dataclass
class Model:
    """Both views, their calibrations and how they are joined; ``prior`` alone where there is nothing to learn."""

    prior: float = 0.5
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    scale: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    joined: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def combine(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (a, b), (c, d) = self.scale
        lt, lm = a * zt + b, c * zm + d
        return sigmoid(lt), sigmoid(lm), sigmoid(self.joined[0] * lt + self.joined[1] * lm + self.joined[2])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        meta = meta_features(batch.column(2), batch.column(3), batch.column(4))
        packed = [on.astype("<u2").tobytes() + v.astype("<f4").tobytes() for on, v in text_features(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary()), pa.array([m.astype("<u2").tobytes() for m in meta], pa.binary()), batch.column(5), batch.column(6)], ["id", "t", "m", "y", "h"])


def _rows(packed: list[bytes], size: int, width: int) -> Rows:
    """size: bytes a value has besides its bucket."""
    n = [len(p) // (2 + size) for p in packed]
    row = np.repeat(np.arange(len(packed)), n)
    col = np.concatenate([np.frombuffer(p, "<u2", k) for p, k in zip(packed, n, strict=True)]).astype(np.int64)
    val = np.concatenate([np.frombuffer(p, "<f4", k, 2 * k) for p, k in zip(packed, n, strict=True)]) if size else np.ones(len(col))
    return Rows(row, col, val.astype(float), len(packed), width)


def class_sums(x: Rows, y: np.ndarray) -> np.ndarray:
    """Sums of the features of the rows of class 0 and of class 1; other rows count for nothing."""
    return np.stack([np.bincount(x.col, x.val * (y == c)[x.row], x.width) for c in (0, 1)])


def bayes(sums: np.ndarray, smooth: float) -> np.ndarray:
    """Log odds of class 1 by feature, of one feature sum to the class's whole."""
    p = sums + smooth
    w = np.log(p / p.sum(1, keepdims=True))
    return w[1] - w[0]


def _pseudo(shared, sure: float):
    """Sums (view, class, feature, total) of the documents that the other view is sure of, and their numbers (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = [np.zeros((2, BUCKETS)), np.zeros((2, META))]
        many = np.zeros((2, 2))
        for batch in batches:
            meta = meta_features(batch.column(2), batch.column(3), batch.column(4))
            words = list(text_features(batch.column(1)))
            p, q, _ = m.combine(np.array([float((m.text[on] * v).sum()) for on, v in words]), m.meta[meta].sum(1))
            for view, odds in ((0, q), (1, p)):
                for c, rows in enumerate((np.flatnonzero(odds <= 1 - sure), np.flatnonzero(odds >= sure))):
                    many[view, c] += len(rows)
                    if view:
                        total[1][c] += np.bincount(meta[rows].ravel(), minlength=META)
                    else:
                        for i in rows:
                            on, v = words[i]
                            total[0][c, on] += v
        tidy()
        for view in (0, 1):
            for c in (0, 1):
                on = np.flatnonzero(total[view][c])
                cols = np.r_[-1, on], np.r_[many[view, c], total[view][c, on]]
                yield pa.record_batch([pa.array(np.full(len(on) + 1, view, np.int32)), pa.array(np.full(len(on) + 1, c, np.int32)), pa.array(cols[0].astype(np.int64)), pa.array(cols[1])], ["view", "c", "f", "total"])

    return run


SMOOTH = (0.01, 1.0)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", max_labelled: int = 4000, rounds: int = 2, sure: float = 0.95) -> Model:
    """Fit on labels (key, target of 0 or 1; other values and null keys are left out) and all other documents.

    In each of ``rounds`` either view hands the other all documents without a label that it is sure of; in each class
    they weigh as much as the labelled ones at most. A key labelled twice has its largest label; of documents that
    repeat a labelled key, that of least hash is learned from. Without two classes the model is the prior.
    """
    slim = _columns(docs, key)
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    known = stored(labels.where(F.col(quoted(key)).isNotNull() & F.col(quoted(target)).isin(0, 1)).groupBy(F.col(quoted(key)).alias("id")).agg(F.max(quoted(target)).cast("int").alias("y")), "labels")
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or good in (0, n):
        return Model(prior=good / n if n else 0.5)
    prior = good / n
    some = known.where(part <= int(min(1.0, max_labelled / n) * (1 << 30)))  # bounded: about max_labelled ids
    drawn = slim.join(F.broadcast(some), "id").withColumn("h", F.xxhash64("text", "source", "lang", "n_chars"))
    featured = drawn.mapInArrow(_features, f"id {slim.schema['id'].dataType.simpleString()}, t binary, m binary, y int, h long")
    rows = featured.groupBy("id").agg(F.min_by(F.struct("t", "m", "y"), "h").alias("r")).select("id", "r.*").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    y = np.array([r.y for r in rows], float)
    fold = np.arange(len(y)) % 4 == 3
    if not all((y[k] == c).any() for k in (fold, ~fold) for c in (0, 1)):
        return Model(prior=prior)
    x = (_rows([bytes(r.t) for r in rows], 4, BUCKETS), _rows([bytes(r.m) for r in rows], 0, META))
    of = np.where(fold, -1, y)
    given = [class_sums(x[v], of) for v in (0, 1)]
    sums = given
    free = slim.join(small(known.select("id"), n, 24), "id", "left_anti")
    for k in range(rounds + 1):
        w = [bayes(sums[v], SMOOTH[v]) for v in (0, 1)]
        z = [x[v].dot(w[v]) for v in (0, 1)]
        model = Model(prior, w[0], w[1], tuple(platt(z[v][fold], y[fold]) for v in (0, 1)))
        if k == rounds:
            break
        shared = docs.sparkSession.sparkContext.broadcast(model)
        found = free.mapInArrow(_pseudo(shared, sure), "view int, c int, f long, total double").groupBy("view", "c", "f").agg(F.sum("total").alias("total")).collect()
        more, many = [np.zeros((2, BUCKETS)), np.zeros((2, META))], np.zeros((2, 2))
        for r in found:
            if r.f < 0:
                many[r.view, r.c] = r.total
            else:
                more[r.view][r.c, r.f] = r.total
        labelled = np.array([(of == 0).sum(), (of == 1).sum()])
        scale = np.minimum(1, labelled / np.maximum(many, 1))
        sums = [given[v] + more[v] * scale[v][:, None] for v in (0, 1)]
    lt, lm = (model.scale[v][0] * z[v][fold] + model.scale[v][1] for v in (0, 1))
    both = Rows(np.repeat(np.arange(len(lt)), 2), np.tile([0, 1], len(lt)), np.stack([lt, lm], 1).ravel(), len(lt), 2)
    model.joined = logistic(both, y[fold], np.ones(len(lt)), np.array([1.0, 0.0, 0.0]), 200, 1e-3)
    return model


def _columns(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(quoted(key)).alias("id"), F.col("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, text_score, meta_score, score, keep) for each row of docs; scores are calibrated probabilities.

    Null and empty texts have no trigram and get what the calibration and their metadata give. keep: score is ``threshold``
    or more; a model that is only a prior keeps all. Columns of docs beyond the five named aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    slim = _columns(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m.text is None:
                t = f = s = np.full(len(batch), m.prior)
            else:
                zt = np.array([float((m.text[on] * v).sum()) for on, v in text_features(batch.column(1))])
                zm = m.meta[meta_features(batch.column(2), batch.column(3), batch.column(4))].sum(1)
                t, f, s = m.combine(zt, zm)
            keep = s >= threshold if m.text is not None else np.ones(len(batch), bool)
            yield pa.record_batch([batch.column(0), pa.array(t, pa.float64()), pa.array(f, pa.float64()), pa.array(s, pa.float64()), pa.array(keep)], ["id", "text_score", "meta_score", "score", "keep"])
        tidy()

    return slim.mapInArrow(run, f"id {kind}, text_score double, meta_score double, score double, keep boolean").withColumnRenamed("id", key)
