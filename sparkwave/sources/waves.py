"""Turning run output into the long tables the operators work on.

``waves(run, sig, i, t, v)`` holds one sample per row: ``i`` is the ordinal of
the sample in its run and ``t`` never decreases with it. ``spectra(run, sig, f,
re, im)`` holds one complex point per row. NaN becomes NULL here, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def clean(value: Column | str) -> Column:
    """A double with NaN turned into NULL."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(c), c)


def seconds_since(ts: Column | str, epoch: str = EPOCH) -> Column:
    """Seconds from a fixed instant, exact to the microsecond in any session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    gap = c.cast("timestamp_ntz") - F.lit(epoch).cast("timestamp_ntz")
    return gap.cast("interval second").cast("decimal(20,6)").cast("double")


def waves_from_wide(df: DataFrame, x: str, signals: Sequence[str], ids: Sequence[str] = ("run", "i")) -> DataFrame:
    """One column per signal to one row per signal and sample."""
    ready = df.select(*ids, F.col(x).cast("double").alias("t"), *[clean(s).alias(s) for s in signals])
    return ready.unpivot([*ids, "t"], list(signals), "sig", "v")


def wide_from_waves(waves: DataFrame, signals: Sequence[str], ids: Sequence[str] = ("run", "i")) -> DataFrame:
    """The inverse, for an explicit list of signals."""
    wanted = waves.where(F.col("sig").isin(*signals))
    return wanted.groupBy(*ids).agg(
        F.min("t").alias("t"), *[F.max(F.when(F.col("sig") == s, F.col("v"))).alias(s) for s in signals]
    )


def spectra_from_wide(df: DataFrame, f: str, signals: Sequence[str], ids: Sequence[str] = ("run",)) -> DataFrame:
    """Columns ``<signal>_re`` and ``<signal>_im`` to one complex point per row."""
    points = F.array(
        *[
            F.struct(F.lit(s).alias("sig"), clean(f"{s}_re").alias("re"), clean(f"{s}_im").alias("im"))
            for s in signals
        ]
    )
    return df.select(*ids, F.col(f).cast("double").alias("f"), F.inline(points))


def waves_from_events(
    df: DataFrame, ts: str, sig: str, value: str, run: Column | str, i: str, epoch: str = EPOCH
) -> DataFrame:
    """A table of timestamped readings as waves; ``i`` orders readings of one instant."""
    return df.select(
        (F.col(run) if isinstance(run, str) else run).cast("long").alias("run"),
        F.col(sig).alias("sig"),
        F.col(i).cast("long").alias("i"),
        seconds_since(ts, epoch).alias("t"),
        clean(value).alias("v"),
    )
