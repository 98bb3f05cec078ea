"""Resampling, Fourier coefficients, distortion and frequency-response measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.functions.scalar import decibels, phase_degrees
from sparkwave.operators import measure as M
from sparkwave.operators import samples as S
from sparkwave.plans import chunks as C
from sparkwave.plans.sizing import broadcast_if_small

HALF_POWER_DB = 3.0103


def _last_periods(waves: DataFrame, freq: float, periods: int, keys: Sequence[str]) -> DataFrame:
    """Per key the window of whole periods that ends with the run, or why there is none."""
    if not freq > 0:
        raise ValueError("the fundamental frequency must be positive")
    span = max(1, int(periods)) / freq
    ends = waves.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("tmin"), F.max("t").alias("t1"))
    t0 = F.col("t1") - span
    error = F.when(F.col("n") < 2, F.lit(M.TOO_SHORT)).when(
        t0 < F.col("tmin"), F.lit(f"the run is shorter than {max(1, int(periods))} period(s)")
    )
    return ends.select(*keys, t0.alias("t0"), "t1", error.alias("error"))


def resample(
    waves: DataFrame, freq: float, periods: int = 1, n: int = 1024, keys: Sequence[str] = S.KEYS,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``n`` equidistant values over the last whole periods, end excluded.

    Keys that are too short give no rows; ``resample_errors`` lists them.
    """
    span = max(1, int(periods)) / freq
    windows = _last_periods(waves, freq, periods, keys).where(F.col("error").isNull()).drop("error")
    points = windows.select(
        *keys, "t0", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    ).select(*keys, "k", (F.col("t0") + F.lit(span) * F.col("k") / n).alias("x"))
    # only samples of the window, and the last instant before it, are sorted
    placed = waves.join(broadcast_if_small(windows.select(*keys, "t0")), list(keys))
    before = placed.groupBy(*keys).agg(F.max(F.when(F.col("t") < F.col("t0"), F.col("t"))).alias("_before"))
    late = placed.join(broadcast_if_small(before), list(keys)).where(F.col("t") >= F.coalesce("_before", "t0")).drop("t0", "_before")
    rows, split = S.samples(late, keys, rows_per_chunk)
    read = M.read_at(rows.drop(C.CHUNK), points, split, keys)
    return read.select(*keys, "k", F.col("x").alias("t"), "v")


def resample_errors(waves: DataFrame, freq: float, periods: int = 1, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return _last_periods(waves, freq, periods, keys).where(F.col("error").isNotNull()).select(*keys, "error")


def fourier(
    waves: DataFrame, freq: float, harmonics: int = 9, periods: int = 1, samples: int = 1024,
    keys: Sequence[str] = S.KEYS, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Harmonics 0..H of every key: magnitude, phase, and both relative to the first.

    Harmonic 0 is the magnitude of the mean; ``mean`` keeps its sign. A key with
    missing samples in the window has NULL harmonics.
    """
    top = max(1, harmonics)
    periods = max(1, int(periods))
    n = max(samples, 8 * top)
    grid = resample(waves, freq, periods, n, keys, rows_per_chunk)
    turn = F.lit(-2 * math.pi * periods / n) * F.col("k")
    sums = []
    whole = F.count("v") == F.count(F.lit(1))
    for h in range(top + 1):
        sums += [F.when(whole, F.sum(F.col("v") * f(turn * h))).alias(f"{part}{h}") for part, f in (("re", F.cos), ("im", F.sin))]
    # one partially aggregated row per key instead of a row per sample and harmonic
    flat = grid.groupBy(*keys).agg(*sums)
    scale = lambda h: (1 if h == 0 else 2) / n
    items = F.array(
        *[
            F.struct(
                F.lit(h).alias("n"),
                F.lit(h * float(freq)).alias("freq"),
                (F.hypot(f"re{h}", f"im{h}") * scale(h)).alias("mag"),
                phase_degrees(f"re{h}", f"im{h}").alias("phase"),
            )
            for h in range(top + 1)
        ]
    )
    with_first = flat.select(
        *keys,
        (F.col("re0") / n).alias("mean"),
        (F.hypot("re1", "im1") * scale(1)).alias("_mag1"),
        phase_degrees("re1", "im1").alias("_phase1"),
        F.inline(items),
    )
    return with_first.select(
        *keys, "n", "freq", "mag",
        F.when(F.col("_mag1") > 0, F.col("mag") / F.col("_mag1")).when(F.col("_mag1").isNotNull(), 0.0).alias("norm"),
        "phase", (F.col("phase") - F.col("_phase1")).alias("phase_norm"), "mean",
    )


def thd(harmonics: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Distortion in percent of the fundamental, and the DC magnitude."""
    g = harmonics.groupBy(*keys).agg(
        F.sum(F.when(F.col("n") >= 2, F.col("mag") * F.col("mag"))).alias("_sq"),
        F.max(F.when(F.col("n") == 1, F.col("mag"))).alias("_mag1"),
        F.max(F.when(F.col("n") == 0, F.col("mag"))).alias("dc"),
        F.max(F.when(F.col("n") == 0, F.col("mean"))).alias("mean"),
    )
    ratio = F.when(
        F.col("_mag1") > 0, F.sqrt(F.coalesce("_sq", F.lit(0.0))) / F.col("_mag1") * 100
    ).otherwise(0.0)
    return g.select(*keys, "dc", "mean", ratio.alias("thd"))


def fourier_window(waves: DataFrame, freq: float, periods: int = 1, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return _last_periods(waves, freq, periods, keys)


# ------------------------------------------------------------------ frequency response


def bode(spectra: DataFrame) -> DataFrame:
    """Magnitude in dB (never below -6000) and phase in degrees."""
    return spectra.withColumn("db", decibels("re", "im")).withColumn("phase", phase_degrees("re", "im"))


def peak_db(spectra: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return bode(spectra).groupBy(*keys).agg(F.max("db").alias("peak_db"))


def bandwidth_3db(spectra: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Lowest frequency at least 3 dB under the peak, or the last frequency."""
    b = bode(spectra)
    peak = b.groupBy(*keys).agg(F.max("db").alias("_peak"))
    low = F.col("db") <= F.col("_peak") - HALF_POWER_DB
    return b.join(peak, list(keys)).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(low, F.col("f"))), F.max("f")).alias("bw3db")
    )


def dc_gain_db(spectra: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return bode(spectra).groupBy(*keys).agg(F.min_by("db", "f").alias("gain_db"))


def nearest_log(spectra: DataFrame, at: Sequence[float], keys: Sequence[str] = S.KEYS) -> DataFrame:
    """dB at the grid frequency nearest to each asked one on a log scale."""
    asked = F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("at")
    b = bode(spectra).select(*keys, "f", "db", asked)
    far = F.struct(F.abs(F.ln(F.col("f") / F.col("at"))), F.col("f"))
    return b.groupBy(*keys, "at").agg(F.min_by("f", far).alias("f"), F.min_by("db", far).alias("db"))


def unity_gain_freq(
    spectra: DataFrame, keys: Sequence[str] = S.KEYS, rows_per_chunk: int | None = None
) -> DataFrame:
    """First fall of the magnitude through 1, interpolated on log-log axes."""
    b = spectra.select(
        *keys, F.log10("f").alias("t"), F.lit(0).cast("long").alias("i"),
        F.log10(F.greatest(F.hypot("re", "im"), F.lit(1e-300))).alias("v"),
    )
    rows, _ = S.samples(b, keys, rows_per_chunk)
    falls = rows.where((F.col("v") > 0) & (F.col("v_next") <= 0))
    at = F.col("t") - F.col("v") / (F.col("v_next") - F.col("v")) * (F.col("x_next") - F.col("t"))
    return falls.groupBy(*keys).agg(F.min_by(F.pow(F.lit(10.0), at), F.col("t")).alias("unity_gain_freq"))
