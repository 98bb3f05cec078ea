"""Resampling and Fourier analysis of the events, and a frequency response per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwave.functions.grids import grid_log
from sparkwave.operators import spectral as P
from sparkwave.sources.waves import spectra_from_wide
from sparkwave.suite.registry import query, rounded, table
from sparkwave.suite.wave_queries import PRE, waves

PERIOD, PERIODS, GRID = 1_200_000.0, 2, 256
FREQ = 1 / PERIOD

RESAMPLED = PRE + f""", b AS (SELECT run, sig, min(t) AS t0, max(t) AS tn, max(t) - {PERIODS * PERIOD} AS start FROM w GROUP BY run, sig HAVING count(*) >= 2 AND max(t) - {PERIODS * PERIOD} >= min(t)),
p AS (SELECT run, sig, k, start + {PERIODS * PERIOD} * k / {{n}} AS x FROM b, (SELECT unnest(range({{n}})) AS k)),
g AS (SELECT run, sig, t, v, t1, v1 FROM s WHERE t1 IS NOT NULL),
f AS (SELECT run, sig, arg_min({{{{t: t, v: v, t1: t1, v1: v1}}}}, t) AS q FROM g GROUP BY run, sig),
a AS (SELECT p.*, g.t, g.v, g.t1, g.v1 FROM p ASOF LEFT JOIN g ON p.run = g.run AND p.sig = g.sig AND p.x > g.t),
r AS (SELECT a.run, a.sig, a.k, a.x, coalesce(a.t, f.q.t) AS t, coalesce(a.v, f.q.v) AS v, coalesce(a.t1, f.q.t1) AS t1, coalesce(a.v1, f.q.v1) AS v1
      FROM a JOIN f ON a.run = f.run AND a.sig = f.sig),
y AS (SELECT run, sig, k, x, CASE WHEN t1 > t THEN v + (v1 - v) * (x - t) / (t1 - t) ELSE v END AS v FROM r)
"""


def _res(n: int) -> str:
    return RESAMPLED.replace("{n}", str(n)).replace("{{", "{").replace("}}", "}")


HARM = _res(1024) + f""", h AS (SELECT unnest(range(10)) AS n),
c AS (SELECT run, sig, n, sum(v * cos(-2 * pi() * n * {PERIODS} * k / 1024)) AS re, sum(v * sin(-2 * pi() * n * {PERIODS} * k / 1024)) AS im FROM y, h GROUP BY run, sig, n),
m AS (SELECT run, sig, CAST(n AS INTEGER) AS n, n * {FREQ} AS freq, sqrt(re * re + im * im) * CASE WHEN n = 0 THEN 1 ELSE 2 END / 1024 AS mag, degrees(atan2(im, re)) AS phase FROM c)
"""


@query("res1_resample", _res(GRID) + "SELECT run, sig, CAST(k AS INTEGER) AS k, round(x, 4) AS t, round(v, 5) AS v FROM y")
def res1(spark, sf):
    got = P.resample(waves(spark, sf), FREQ, PERIODS, GRID)
    return got.select("run", "sig", "k", rounded("t", 4), rounded("v", 5))


@query("res1_resample_split_keys", _res(GRID) + "SELECT run, sig, CAST(k AS INTEGER) AS k, round(x, 4) AS t, round(v, 5) AS v FROM y")
def res1_split(spark, sf):
    got = P.resample(waves(spark, sf), FREQ, PERIODS, GRID, rows_per_chunk=80)
    return got.select("run", "sig", "k", rounded("t", 4), rounded("v", 5))


@query(
    "res1_refused",
    PRE + """SELECT run, sig, 'the run is shorter than 3 period(s)' AS error FROM w GROUP BY run, sig HAVING max(t) - 3600000 < min(t)""",
)
def res1_refused(spark, sf):
    return P.resample_errors(waves(spark, sf), FREQ, 3)


@query("agg13_fourier", HARM + "SELECT run, sig, n, round(mag, 6) AS mag FROM m")
def agg13(spark, sf):
    return P.fourier(waves(spark, sf), FREQ, 9, PERIODS).select("run", "sig", "n", rounded("mag"))


@query(
    "agg14_harmonic_norm",
    HARM + """SELECT m.run, m.sig, m.n, round(m.mag / o.mag, 5) AS norm, round(m.phase - o.phase, 4) AS phase_norm
    FROM m JOIN m o ON m.run = o.run AND m.sig = o.sig AND o.n = 1 WHERE m.n > 0""",
)
def agg14(spark, sf):
    got = P.fourier(waves(spark, sf), FREQ, 9, PERIODS).where(F.col("n") > 0)
    return got.select("run", "sig", "n", rounded("norm", 5), rounded("phase_norm", 4))


@query(
    "agg15_thd",
    HARM + """SELECT run, sig, round(max(mag) FILTER (n = 0), 6) AS dc,
    round(sqrt(sum(mag * mag) FILTER (n >= 2)) / max(mag) FILTER (n = 1) * 100, 4) AS thd FROM m GROUP BY run, sig""",
)
def agg15(spark, sf):
    return P.thd(P.fourier(waves(spark, sf), FREQ, 9, PERIODS)).select("run", "sig", rounded("dc"), rounded("thd", 4))


# ------------------------------------------------------------------ frequency response

PER_DECADE, START, STOP = 5, 1.0, 1e6


def spectra(spark, sf):
    """A first-order low-pass per part: gain from its price, corner from its size."""
    # a small file is read by one task; its parts are spread before they become 31 points each
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size").repartition(tasks, "p_partkey")
    f = p.select(
        F.col("p_partkey").alias("run"),
        (F.col("p_retailprice") / 100).alias("gain"),
        (F.col("p_size") * 100.0).alias("corner"),
        F.explode(grid_log("dec", F.lit(PER_DECADE), F.lit(START), F.lit(STOP))).alias("f"),
    )
    x = F.col("f") / F.col("corner")
    wide = f.select(
        "run", "f", (F.col("gain") / (1 + x * x)).alias("out_re"), (-F.col("gain") * x / (1 + x * x)).alias("out_im")
    )
    return spectra_from_wide(wide, "f", ["out"])


AC = f"""
WITH g AS (SELECT {START} * exp(ln(10.0) * i / {PER_DECADE}) AS f FROM (SELECT unnest(range(31)) AS i)),
z AS (SELECT p_partkey AS run, f, p_retailprice / 100 AS gain, f / (p_size * 100.0) AS x FROM part, g),
c AS (SELECT run, 'out' AS sig, f, gain / (1 + x * x) AS re, -gain * x / (1 + x * x) AS im FROM z),
b AS (SELECT *, 20 * log10(CASE WHEN re = 0 AND im = 0 THEN 1e-300 ELSE sqrt(re * re + im * im) END) AS db, degrees(atan2(im, re)) AS phase FROM c),
p AS (SELECT run, sig, max(db) AS peak FROM b GROUP BY run, sig)
"""


@query("src2_spectra_from_wide", AC + "SELECT run, sig, round(f, 4) AS f, round(re, 6) AS re, round(im, 6) + 0.0 AS im FROM c")
def src2(spark, sf):
    return spectra(spark, sf).select("run", "sig", rounded("f", 4), rounded("re"), rounded("im"))


@query("prj6_bode", AC + "SELECT run, sig, round(f, 4) AS f, round(db, 6) AS db, round(phase, 6) AS phase FROM b")
def prj6(spark, sf):
    return P.bode(spectra(spark, sf)).select("run", "sig", rounded("f", 4), rounded("db"), rounded("phase"))


@query("agg10_peak_db", AC + "SELECT run, sig, round(peak, 6) AS peak_db FROM p")
def agg10(spark, sf):
    return P.peak_db(spectra(spark, sf)).select("run", "sig", rounded("peak_db"))


@query(
    "agg11_bandwidth_3db",
    AC + """SELECT b.run, b.sig, round(coalesce(min(f) FILTER (db <= peak - 3.0103), max(f)), 4) AS bw3db
    FROM b JOIN p ON b.run = p.run AND b.sig = p.sig GROUP BY b.run, b.sig""",
)
def agg11(spark, sf):
    return P.bandwidth_3db(spectra(spark, sf)).select("run", "sig", rounded("bw3db", 4))


@query("agg12_dc_gain", AC + "SELECT run, sig, round(arg_min(db, f), 6) AS gain_db FROM b GROUP BY run, sig")
def agg12(spark, sf):
    return P.dc_gain_db(spectra(spark, sf)).select("run", "sig", rounded("gain_db"))


@query(
    "join3_nearest_log",
    AC + """, q AS (SELECT unnest([CAST(33.0 AS DOUBLE), 4500.0]) AS "at")
    SELECT run, sig, "at", round(arg_min(f, (abs(ln(f / "at")), f)), 4) AS f, round(arg_min(db, (abs(ln(f / "at")), f)), 6) AS db FROM b, q GROUP BY run, sig, "at\"""",
)
def join3(spark, sf):
    return P.nearest_log(spectra(spark, sf), [33.0, 4500.0]).select("run", "sig", "at", rounded("f", 4), rounded("db"))


@query(
    "agg23_unity_gain",
    AC + """, l AS (SELECT run, sig, log10(f) AS x, log10(sqrt(re * re + im * im)) AS y FROM c),
    n AS (SELECT *, lead(x) OVER k AS x1, lead(y) OVER k AS y1 FROM l WINDOW k AS (PARTITION BY run, sig ORDER BY x)),
    u AS (SELECT run, sig, x, pow(10, x - y / (y1 - y) * (x1 - x)) AS f FROM n WHERE y > 0 AND y1 <= 0)
    SELECT run, sig, round(arg_min(f, x), 3) AS unity_gain_freq FROM u GROUP BY run, sig""",
)
def agg23(spark, sf):
    return P.unity_gain_freq(spectra(spark, sf)).select("run", "sig", rounded("unity_gain_freq", 3))


