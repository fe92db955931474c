"""Small fits on the driver, over a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; ``x`` without the constant, whose weight comes first in the result."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 10.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(text, y) of about ``most`` labelled rows at most, drawn by a hash of doc_id.

    ``usable`` is a predicate on doc_id.  Ids with several labels take the
    largest.  The sample's ids are broadcast: there are about ``most``.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).alias("y"))
    total = known.count()
    if total > most:
        parts = 1 << 30
        known = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(parts)) < int(parts * most / total))
    known = known.withColumnRenamed("doc_id", "__id")
    if min(total, most) <= broadcast_rows:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y"))
