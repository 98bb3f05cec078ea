"""Comparing two runs of the same signals with a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.operators import measure as M
from sparkwave.operators import samples as S


def diff_runs(
    ours: DataFrame, reference: DataFrame, rtol: float = 1e-3, atol: float = 1e-12, floor: float = 0.0,
    relative_to: str = "reference", keys: Sequence[str] = S.KEYS, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Our nearest sample against every reference sample.

    Passes within ``max(atol, rtol*|b|)``, or within ``rtol*max(|b|, 1)`` for
    ``relative_to="unit"``. Reference values smaller than ``floor`` are left out.
    A sample that is missing on either side does not pass; ``missing`` says so.
    """
    b = reference.where(F.col("v").isNull() | (F.abs("v") >= floor)).select(*keys, "i", F.col("t").alias("x"), F.col("v").alias("b"))
    got = M.nearest(ours, b, keys, "x", rows_per_chunk).withColumnRenamed("v", "a")
    gap = F.abs(F.col("a") - F.col("b"))
    size = F.abs("b")
    allowed = rtol * F.greatest(size, F.lit(1.0)) if relative_to == "unit" else F.greatest(F.lit(atol), rtol * size)
    return got.select(
        *keys, "i", "x", "t_near", "a", "b", gap.alias("abs_err"),
        F.try_divide(gap, size).alias("rel_err"), F.coalesce(gap <= allowed, F.lit(False)).alias("ok"),
        gap.isNull().alias("missing"),
    )


def worst_error(diff: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Largest relative error of each key, the place of it, and how many failed.

    A missing sample counts as failed and makes the largest error infinite.
    """
    at = F.struct(F.col("rel_err"), -F.col("i"))
    return diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.when(F.max("missing"), F.lit(float("inf"))).otherwise(F.max("rel_err")).alias("worst"),
        F.max_by("x", F.when(F.col("rel_err").isNotNull(), at)).alias("worst_at"),
    )
