"""Waveforms from source specifications, and the instants where they bend.

``wave_specs(run, sig, kind, p ARRAY<DOUBLE>, pwl ARRAY<STRUCT<t, v>>)``; missing
or NULL entries of ``p`` take the defaults of their kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.operators import measure as M

TINY = 1e-300
KINDS = ("DC", "SIN", "PULSE", "PWL", "EXP", "SFFM", "AM")


def _arg(ix: int, default=None) -> Column:
    got = F.get(F.col("p"), F.lit(ix))
    if default is None:
        return got
    return F.coalesce(got, default if isinstance(default, Column) else F.lit(float(default)))


def spec_value(kind: Column, t: Column, tstep: float, tstop: float) -> Column:
    """Value of a spec row at ``t`` for every kind except PWL."""
    step, stop = F.lit(float(tstep)), F.lit(float(tstop))
    turn = 2 * math.pi

    vo, va, td = _arg(0, 0), _arg(1, 0), _arg(3, 0)
    offset = F.radians(_arg(5, 0))
    dt = t - td
    sine = F.when(t < td, vo + va * F.sin(offset)).otherwise(
        vo + va * F.exp(-dt * _arg(4, 0)) * F.sin(turn * _arg(2, 1 / stop) * dt + offset)
    )

    v1, v2, pd = _arg(0, 0), _arg(1, 1), _arg(2, 0)
    tr, tf, pw, per = _arg(3, step), _arg(4, step), _arg(5, stop), _arg(6, stop)
    x = t - pd
    x = F.when((per > 0) & (x >= per), x - F.floor(x / F.when(per > 0, per)) * per).otherwise(x)
    guard = lambda w: F.when(w != 0, w).otherwise(F.lit(TINY))
    pulse = (
        F.when(t < pd, v1)
        .when(x < tr, v1 + (v2 - v1) * x / guard(tr))
        .when(x < tr + pw, v2)
        .when(x < tr + pw + tf, v2 + (v1 - v2) * (x - tr - pw) / guard(tf))
        .otherwise(v1)
    )

    td1, tau1, td2, tau2 = _arg(2, 0), _arg(3, step), _arg(4, stop), _arg(5, step)
    rise = F.when(t > td1, (v2 - v1) * (1 - F.exp(-(t - td1) / guard(tau1)))).otherwise(0.0)
    fall = F.when(t > td2, (v1 - v2) * (1 - F.exp(-(t - td2) / guard(tau2)))).otherwise(0.0)

    fm = _arg(0, 0) + _arg(1, 1) * F.sin(
        turn * _arg(2, 1 / stop) * t + _arg(3, 0) * F.sin(turn * _arg(4, 1 / stop) * t)
    )

    ad = t - _arg(4, 0)
    am = F.when(t < _arg(4, 0), 0.0).otherwise(
        _arg(0, 1) * (_arg(1, 0) + F.sin(turn * _arg(2, 1) * ad)) * F.sin(turn * _arg(3, 1 / stop) * ad)
    )
    return (
        F.when(kind == "DC", _arg(0, 0)).when(kind == "SIN", sine).when(kind == "PULSE", pulse)
        .when(kind == "EXP", v1 + rise + fall).when(kind == "SFFM", fm).when(kind == "AM", am)
    )


def synth_waves(specs: DataFrame, tstop: float, n: int, tstep: float | None = None) -> DataFrame:
    """``n + 1`` samples over [0, tstop] of every spec row.

    Piecewise-linear specs go through the as-of join on their own points.
    """
    tstep = tstep if tstep is not None else tstop / n
    kind = F.upper("kind")
    grid = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("i")
    t = F.lit(float(tstop)) * F.col("i") / n
    plain = (
        specs.where(kind != "PWL").select("run", "sig", "kind", "p", grid)
        .select("run", "sig", "i", t.alias("t"), spec_value(kind, t, tstep, tstop).alias("v"))
    )
    pwl = specs.where(kind == "PWL")
    points = pwl.select("run", "sig", grid).select("run", "sig", "i", t.alias("x"))
    knots = pwl.select("run", "sig", F.posexplode("pwl").alias("_k", "_p")).select(
        "run", "sig", F.col("_k").cast("long").alias("i"), F.col("_p.t").alias("t"), F.col("_p.v").alias("v")
    )
    return plain.unionByName(_pwl_values(knots, points))


def _pwl_values(knots: DataFrame, points: DataFrame) -> DataFrame:
    """Linear between the knots, flat outside; the later of two knots at one instant holds after it."""
    ends = knots.groupBy("run", "sig").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("t", "i", "v")).alias("_a"), F.max(F.struct("t", "i", "v")).alias("_b")
    )
    read = M.value_at(knots, points).select("run", "sig", "i", "x", "v")
    out = points.join(ends, ["run", "sig"], "left").join(read.drop("x"), ["run", "sig", "i"], "left")
    x = F.col("x")
    value = (
        F.when(F.col("_n").isNull(), 0.0)
        .when(x <= F.col("_a.t"), F.col("_a.v"))
        .when(x > F.col("_b.t"), F.col("_b.v"))
        .otherwise(F.col("v"))
    )
    return out.select("run", "sig", "i", x.alias("t"), value.alias("v"))


def breakpoints(specs: DataFrame, tstop: float) -> DataFrame:
    """``(run, sig, k, t)``: sorted instants in [0, tstop] where a spec bends."""
    stop = F.lit(float(tstop))
    kind = F.upper("kind")
    td, tr, tf, pw, per = _arg(2, 0), _arg(3, 0), _arg(4, 0), _arg(5, 0), _arg(6, 0)
    edges = lambda s: F.array(s, s + tr, s + tr + pw, s + tr + pw + tf)
    # starts strictly before tstop
    last = F.ceil((stop - td) / F.when(per > 0, per)) - 1
    starts = F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda k: td + k * per))
    pulses = F.when(per > 0, F.flatten(F.transform(F.coalesce(starts, F.array().cast("array<double>")), edges))).otherwise(edges(td))
    all_ = (
        F.when(kind == "PULSE", pulses)
        .when(kind == "PWL", F.transform("pwl", lambda q: q["t"]))
        .when(kind == "EXP", F.array(_arg(2, 0), _arg(4, 0)))
        .when(kind == "SIN", F.array(_arg(3, 0)))
    )
    kept = F.array_sort(F.filter(all_, lambda x: (x >= 0) & (x <= stop)))
    return specs.select("run", "sig", F.posexplode(kept).alias("k", "t"))
