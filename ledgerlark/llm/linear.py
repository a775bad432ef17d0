"""Small linear models fitted on the driver with NumPy, and the labelled sample they learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, materialise


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fold(doc_id: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an id as text; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds).cast("int")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, *, doc_id: str = "doc_id", text: str = "text", meta: str | None = None) -> DataFrame:
    """At most ``most`` labelled ids where ``learn`` holds, with text, label ``y`` (0 or 1) and ``part``
    (0 to 4, a hash of the id), written to the shared folder; ``meta`` names a column of whole numbers
    that comes along as ``meta``.

    Ids are taken in the order of a hash, so the sample is the same in every run. Several labels of an
    id count as the greatest, and several texts as the smallest; equal texts count once, with their
    greatest label; null ids and labels are left out.
    """
    bound_batches(documents)
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & learn).groupBy(F.col(doc_id).alias("_id"))
    ids = ids.agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = documents.select(F.col(doc_id).alias("_id"), F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(meta) if meta else F.lit(None)).cast("bigint").alias("meta")).alias("r"))
    # At most ``most`` ids of 16 bytes: the broadcast is bounded by the parameter.
    joined = rows.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("r").alias("r"), F.max("y").alias("y"))
    joined = joined.groupBy("r.text").agg(F.min("_id").alias("_id"), F.min("r.meta").alias("meta"), F.max("y").alias("y"))
    part = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)).cast("int")
    return materialise(joined.select("text", "meta", (F.col("y") > 0).cast("int").alias("y"), part.alias("part")))


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * raw + b) is the chance of label 1, by Newton's method with smoothed
    targets; a is never negative. Without both labels: the smoothed prior."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    prior = np.log((n1 + 1) / (n0 + 1))
    if not n1 or not n0:
        return 0.0, float(prior)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(prior)
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        g, w = p - target, p * (1 - p) + 1e-9
        ga, gb = (g * raw).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (w * raw * raw).sum() + 1e-3, (w * raw).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(prior))


class Rows:
    """Sparse binary rows: ``index[ends[i-1]:ends[i]]`` are the features of row i."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.index = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, v[self.row], self.width)


def sparse_logistic(rows: Rows, target: np.ndarray, weight: np.ndarray, *, l1: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets with an L1 penalty, by accelerated
    proximal gradient."""
    total = max(weight.sum(), 1e-9)
    lengths = np.bincount(rows.row, minlength=rows.n) + 1.0
    # X'X is at most the diagonal of what each feature's rows hold, so these steps never overshoot.
    rate = 4 * total / np.maximum(rows.back(weight * lengths), 1e-6)
    rate_bias = 4 * total / max(float((weight * lengths).sum()), 1e-6)
    rate = np.where(rows.back(weight) > 0, rate, 0.0)
    prior = float((weight * target).sum() / total)
    w = v = np.zeros(rows.width)
    b = c = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    t = 1.0
    for _ in range(steps):
        g = weight * (sigmoid(rows.dot(v) + c) - target) / total
        new = v - rate * rows.back(g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = c - rate_bias * float(g.sum())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b
