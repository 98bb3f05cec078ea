"""Samples with their neighbours, segments, level crossings, decimation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.plans import chunks as C

KEYS = ("run", "sig")
# a crossing found just outside the window by rounding still belongs to it
EDGE_SLACK = 1e-15


def samples(
    waves: DataFrame, keys: Sequence[str] = KEYS, rows_per_chunk: int | None = None,
    x: str = "t", tie: str = "i", value: str = "v",
) -> tuple[DataFrame, C.Chunks]:
    """Every sample with the next one and the ends of its key, and the split used."""
    split = C.plan_chunks(waves, keys, x, tie, rows_per_chunk)
    return C.neighbours(waves, keys, x, tie, value, split), split


def segments(waves: DataFrame, keys: Sequence[str] = KEYS, rows_per_chunk: int | None = None) -> DataFrame:
    """Each sample paired with its successor: ``t, v`` to ``t1, v1``."""
    rows, _ = samples(waves, keys, rows_per_chunk)
    return rows.where(F.col("x_next").isNotNull()).select(
        *keys, "i", "t", "v", F.col("x_next").alias("t1"), F.col("v_next").alias("v1")
    )


def lerp(x: Column, t: Column, v: Column, t1: Column, v1: Column) -> Column:
    """Linear value at ``x``; a zero-width segment keeps its left value."""
    return F.when(t1 > t, v + (v1 - v) * (x - t) / (t1 - t)).otherwise(v)


def lower_end(low: Column) -> Column:
    return F.coalesce(low, F.col("x_first"))


def upper_end(high: Column) -> Column:
    return F.coalesce(high, F.col("x_last"))


def touches_window(low: Column, high: Column) -> Column:
    """Segments that reach into the open window."""
    return (F.col("x_next") > lower_end(low)) & (F.col("t") < upper_end(high))


def clipped_area(low: Column, high: Column, shape=lambda v: v) -> Column:
    """Trapezoid of one segment inside [low, high], its ends interpolated."""
    t, v, t1, v1 = F.col("t"), F.col("v"), F.col("x_next"), F.col("v_next")
    lo, hi = lower_end(low), upper_end(high)
    start, stop = F.greatest(t, lo), F.least(t1, hi)
    left = F.when(t < lo, lerp(lo, t, v, t1, v1)).otherwise(v)
    right = F.when(t1 > hi, lerp(hi, t, v, t1, v1)).otherwise(v1)
    return F.when(stop > start, (shape(left) + shape(right)) / 2 * (stop - start))


def crossing_at(level: Column, edge: Column) -> Column:
    """Where a segment meets ``level``, or NULL; ``edge`` is rise, fall or cross."""
    a, b = F.col("v") - level, F.col("v_next") - level
    rises = (a < 0) & (b >= 0)
    falls = (a > 0) & (b <= 0)
    wanted = (rises & (edge != "fall")) | (falls & (edge != "rise"))
    return F.when(wanted, F.col("t") - a * (F.col("x_next") - F.col("t")) / (b - a))


def crossings(
    waves: DataFrame, level: float, edge: str = "cross", t_from: float | None = None,
    t_to: float | None = None, snap: bool = False, keys: Sequence[str] = KEYS,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """All crossings of ``level``: ``x`` is the interpolated time.

    ``snap=True`` reports the time of the sample that arrives at the level.
    """
    rows, _ = samples(waves, keys, rows_per_chunk)
    return _crossing_rows(rows, level, edge, t_from, t_to, snap).select(*keys, "i", "x")


def _crossing_rows(rows, level, edge, t_from, t_to, snap=False) -> DataFrame:
    low, high = F.lit(t_from).cast("double"), F.lit(t_to).cast("double")
    x = crossing_at(F.lit(float(level)), F.lit(edge))
    found = rows.where(touches_window(low, high)).withColumn("x", x).where(F.col("x").isNotNull())
    inside = (F.col("x") >= lower_end(low) - EDGE_SLACK) & (F.col("x") <= upper_end(high) + EDGE_SLACK)
    found = found.where(inside)
    return found.withColumn("x", F.col("x_next")) if snap else found


def nth_crossing(
    waves: DataFrame, level: float, nth: int, edge: str = "cross", t_from: float | None = None,
    t_to: float | None = None, keys: Sequence[str] = KEYS, rows_per_chunk: int | None = None,
) -> DataFrame:
    """The ``nth`` crossing of every key that has that many."""
    if nth < 1:
        raise ValueError("nth counts from 1")
    rows, split = samples(waves, keys, rows_per_chunk)
    found = _crossing_rows(rows, level, edge, t_from, t_to)
    hit = C.nth_in_key(found, keys, ["t", "i"], F.lit(nth), split.split)
    return hit.select(*keys, F.lit(nth).alias("nth"), "x")


def decimate(
    waves: DataFrame, max_points: int = 2000, keys: Sequence[str] = KEYS, rows_per_chunk: int | None = None
) -> DataFrame:
    """At most ``max_points`` samples per key, by stride, ending on the last one.

    The stride keeps every k-th sample; the final sample takes the place of the
    last one kept.
    """
    most = max(2, max_points)
    split = C.plan_chunks(waves, keys, "t", "i", rows_per_chunk)
    keyed = split.assign(waves, "t", "i")
    placed = C.ranked(keyed, keys, ["t", "i"], "_rank", split.split)
    sizes = waves.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    at = F.col("_rank") - 1
    step = F.greatest(F.ceil(F.col("_size") / most), F.lit(1).cast("long"))
    final = F.col("_rank") == F.col("_size")
    last_slot = F.floor((F.col("_size") - 1) / step)
    return (
        placed.join(sizes, list(keys))
        .withColumn("_step", step)
        .withColumn("slot", F.when(final, last_slot).otherwise(F.floor(at / F.col("_step"))))
        .where(final | ((at % F.col("_step") == 0) & (F.col("slot") < last_slot)))
        .select(*keys, "slot", "i", "t", "v")
    )


def value_range(waves: DataFrame, keys: Sequence[str] = KEYS, pad: float = 0.08) -> DataFrame:
    """Range of the finite values and the padded window to show them in."""
    v = F.col("v")
    finite = F.when(F.abs(v) < float("inf"), v)
    found = waves.groupBy(*keys).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    flat = ~(F.col("hi") > F.col("lo"))
    low = F.when(flat, F.col("lo") - 1).otherwise(F.col("lo"))
    high = F.when(flat, F.col("lo") + 1).otherwise(F.col("hi"))
    return found.select(
        *keys, "lo", "hi",
        (low - (high - low) * pad).alias("show_lo"),
        (high + (high - low) * pad).alias("show_hi"),
    )


def run_stats(waves: DataFrame) -> DataFrame:
    """Points, distinct instants and span of every run."""
    per_step = waves.groupBy("run", "i").agg(F.min("t").alias("t"))
    return per_step.groupBy("run").agg(
        F.count(F.lit(1)).alias("points"), F.min("t").alias("t_first"), F.max("t").alias("t_last")
    )
