"""Bounded samples of labelled rows, and one-dimensional calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out


def _eligible(labels: DataFrame, label: str, parts: int, rest: int, key: str) -> DataFrame:
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key), parts, rest))
    return own.groupBy(F.col(key).alias("key_")).agg(F.max(F.col(label).cast("int")).alias("y"))


def class_weights(labels: DataFrame, label: str, parts: int, rest: int, most: int, key: str = "doc_id") -> tuple[float, float]:
    """How many labels each label of class 0 and of class 1 in labelled_sample() stands for: 1, or more where the class is cut."""
    n = {r.y: r["count"] for r in _eligible(labels, label, parts, rest, key).groupBy("y").count().collect()}
    return tuple(max(1.0, n.get(y, 0) / (most // 2)) for y in (0, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_, text, y, fold) of at most `most` labelled documents outside the held-out fold, those of least hash.

    Each class gets up to half of `most`, so that a rare one is not crowded out. Repeated labels: the greatest counts; null labels and
    ids: left out. A repeated doc_id in docs: each row. fold: 0 to 3, by hash.
    """
    own = _eligible(labels, label, parts, rest, key)
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("key_", F.lit(5)), "key_").limit(most // 2) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    body = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = body.join(F.broadcast(ids), "key_")  # at most `most` rows of two numbers
    return cut(found.withColumn("fold", F.pmod(F.xxhash64("key_", F.lit(9)), F.lit(4)).cast("int")))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b x))), by Newton steps; x is scaled within. One class alone: its smoothed share, b = 0."""
    if len(y) == 0:
        return 0.0, 0.0
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return float(np.log(share / (1 - share))), 0.0
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones_like(x), (x - mean) / scale], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (weight * (p - y)) + ridge * len(y) * w * (0, 1)
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([1e-9, ridge * len(y)]), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)
