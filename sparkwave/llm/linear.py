"""Online learning of sparse linear models, and the bounded sample they learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows a model is fitted on; those with the smallest hash of their id are taken.
MAX_LABELLED = 8000


class Ftrl:
    """Follow-the-regularised-leader updates with per-coordinate rates (McMahan et al. 2013)."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """``at`` holds distinct coordinates and ``w`` their weights."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def labelled_sample(df: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` rows ``(id, text, label)``; labels or ids that are null teach nothing, repeated ids teach once.

    Labels of ids that ``df`` does not have take no place in the sample. The sample of ids is bounded, so it is copied to the tasks and ``df`` is only filtered by it.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    known = known.join(df.select(F.col(id).alias("id")).dropna().distinct(), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    docs = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
