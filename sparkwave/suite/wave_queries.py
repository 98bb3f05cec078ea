"""Measurements, joins and windows over the events table seen as waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwave.functions.scalar import normalize_label
from sparkwave.operators import compare, probes
from sparkwave.operators import measure as M
from sparkwave.operators import samples as S
from sparkwave.sources import waves as W
from sparkwave.suite.registry import query, rounded, table

SIGNALS = ("click", "error", "purchase", "signup", "view")
T_FROM, T_TO = 500000.0, 2000000.0


def waves(spark, sf):
    e = table(spark, sf, "events")
    return W.waves_from_events(e, "ts", "event_type", "value", F.col("user_id") % 8, "event_id")


def wide(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 8).alias("run"), F.col("event_id").alias("i"), W.seconds_since("ts").alias("t"),
        F.col("value").alias("out"), F.get_json_object("props", "$.k").cast("double").alias("ref"),
    )


def two_signals(spark, sf):
    return W.waves_from_wide(wide(spark, sf), "t", ["out", "ref"])


# one row per sample with its neighbours, in plain SQL
PRE = """
WITH w AS (SELECT user_id % 8 AS run, event_type AS sig, event_id AS i,
                  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, value AS v FROM events),
s AS (SELECT *, lead(t) OVER k AS t1, lead(v) OVER k AS v1,
             min(t) OVER (PARTITION BY run, sig) AS t0, max(t) OVER (PARTITION BY run, sig) AS tn,
             count(*) OVER (PARTITION BY run, sig) AS n
      FROM w WINDOW k AS (PARTITION BY run, sig ORDER BY t, i))
"""
PRE2 = """
WITH ww AS (SELECT user_id % 8 AS run, event_id AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t,
                   value AS "out", CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ref FROM events)
"""


@query(
    "src3_waves_from_events",
    PRE + "SELECT run, sig, i, round(t, 6) AS t, v FROM w",
)
def src3(spark, sf):
    return waves(spark, sf).select("run", "sig", "i", rounded("t"), "v")


@query(
    "src1_wide_from_waves",
    PRE2 + """SELECT run, i, round(t, 6) AS t, "out", ref FROM ww""",
)
def src1_back(spark, sf):
    return W.wide_from_waves(two_signals(spark, sf), ["out", "ref"]).select("run", "i", rounded("t"), "out", "ref")


@query(
    "src1_waves_from_wide",
    PRE2 + """SELECT run, i, round(t, 6) AS t, 'out' AS sig, "out" AS v FROM ww
    UNION ALL SELECT run, i, round(t, 6), 'ref', ref FROM ww""",
)
def src1(spark, sf):
    return two_signals(spark, sf).select("run", "i", rounded("t"), "sig", "v")


@query(
    "win1_segments",
    PRE + "SELECT run, sig, i, round(t, 6) AS t, v, round(t1, 6) AS t1, v1 FROM s WHERE t1 IS NOT NULL",
)
def win1(spark, sf):
    return S.segments(waves(spark, sf)).select("run", "sig", "i", rounded("t"), "v", rounded("t1"), "v1")


@query(
    "win1_segments_split_keys",
    PRE + "SELECT run, sig, i, round(t, 6) AS t, v, round(t1, 6) AS t1, v1 FROM s WHERE t1 IS NOT NULL",
)
def win1_split(spark, sf):
    """The same with every key cut into pieces, as for keys too large for a task."""
    return S.segments(waves(spark, sf), rows_per_chunk=100).select("run", "sig", "i", rounded("t"), "v", rounded("t1"), "v1")


# ------------------------------------------------------------------ aggregates

AREAS = PRE + f""", c AS (SELECT run, sig, t, t1, v, v1, greatest(t, {T_FROM}) AS a, least(t1, {T_TO}) AS b FROM s WHERE t1 > {T_FROM} AND t < {T_TO}),
e AS (SELECT run, sig, a, b, v + (v1 - v) * (a - t) / (t1 - t) AS va, v + (v1 - v) * (b - t) / (t1 - t) AS vb FROM c),
x AS (SELECT run, sig, sum((va + vb) / 2 * (b - a)) AS area, sum((va * va + vb * vb) / 2 * (b - a)) AS sq FROM e GROUP BY run, sig),
d AS (SELECT run, sig, least({T_TO}, max(t)) - greatest({T_FROM}, min(t)) AS span FROM w GROUP BY run, sig)
SELECT x.run, x.sig AS name, round({{value}}, {{digits}}) AS value FROM x JOIN d ON x.run = d.run AND x.sig = d.sig
"""
INSIDE = PRE + f"SELECT run, sig AS name, {{value}} AS value FROM w WHERE t >= {T_FROM} AND t <= {T_TO} GROUP BY run, sig"


def _each(spark, sf, func, digits=6, **options):
    specs = [M.Spec(x, func, x, **options) for x in SIGNALS]
    return M.measure(waves(spark, sf), specs).select("run", "name", rounded("value", digits))


WINDOW = {"t_from": T_FROM, "t_to": T_TO}


@query("agg1_integ", AREAS.format(value="x.area", digits=2))
def agg1(spark, sf):
    return _each(spark, sf, "integ", 2, **WINDOW)


@query("agg2_avg", AREAS.format(value="x.area / d.span", digits=6))
def agg2(spark, sf):
    return _each(spark, sf, "avg", **WINDOW)


@query("agg3_rms", AREAS.format(value="sqrt(x.sq / d.span)", digits=6))
def agg3(spark, sf):
    return _each(spark, sf, "rms", **WINDOW)


@query("agg4_max", INSIDE.format(value="max(v)"))
def agg4(spark, sf):
    return _each(spark, sf, "max", **WINDOW)


@query("agg5_min", INSIDE.format(value="min(v)"))
def agg5(spark, sf):
    return _each(spark, sf, "min", **WINDOW)


@query("agg6_pp", INSIDE.format(value="round(max(v) - min(v), 6)"))
def agg6(spark, sf):
    return _each(spark, sf, "pp", **WINDOW)


@query("agg7_final", PRE + "SELECT run, sig AS name, arg_max(v, (t, i)) AS value FROM w GROUP BY run, sig")
def agg7(spark, sf):
    return _each(spark, sf, "final")


@query(
    "agg8_at",
    PRE + "SELECT run, sig AS name, arg_min(v, (abs(t - 1234567.0), i)) AS value FROM w GROUP BY run, sig",
)
def agg8(spark, sf):
    return _each(spark, sf, "nearest", at=1234567.0)


@query(
    "agg9_value_range",
    PRE + """, r AS (SELECT run, sig, min(v) AS lo, max(v) AS hi FROM w GROUP BY run, sig)
    SELECT run, sig, lo, hi, round(lo - (hi - lo) * 0.08, 6) AS show_lo, round(hi + (hi - lo) * 0.08, 6) AS show_hi FROM r""",
)
def agg9(spark, sf):
    return S.value_range(waves(spark, sf)).select("run", "sig", "lo", "hi", rounded("show_lo"), rounded("show_hi"))


@query(
    "agg20_run_stats",
    PRE + "SELECT run, count(DISTINCT i) AS points, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last FROM w GROUP BY run",
)
def agg20(spark, sf):
    return S.run_stats(waves(spark, sf)).select("run", "points", rounded("t_first"), rounded("t_last"))


@query(
    "agg22_slew_rate",
    PRE + """, q AS (SELECT run, sig, min(v) AS lo, max(v) AS hi FROM w GROUP BY run, sig),
    g AS (SELECT s.*, lo + 0.2 * (hi - lo) AS a, lo + 0.8 * (hi - lo) AS b FROM s JOIN q USING (run, sig)),
    ta AS (SELECT run, sig, min(t1) AS t20 FROM g WHERE v < a AND v1 >= a GROUP BY run, sig),
    tb AS (SELECT g.run, g.sig, min(t1) AS t80, any_value(b - a) AS rise FROM g JOIN ta USING (run, sig)
           WHERE v < b AND v1 >= b AND t1 >= t20 GROUP BY g.run, g.sig)
    SELECT run, sig, round(t20, 6) AS t20, round(t80, 6) AS t80,
           round(CASE WHEN t80 > t20 THEN rise / (t80 - t20) END, 6) AS slew FROM ta JOIN tb USING (run, sig)""",
)
def agg22(spark, sf):
    return M.slew_rate(waves(spark, sf)).select("run", "sig", rounded("t20"), rounded("t80"), rounded("slew"))


# ------------------------------------------------------------------ crossings

LEVEL = 20.0
CROSS = PRE + f""", c AS (SELECT run, sig, i, t, t1, v - {LEVEL} AS a, v1 - {LEVEL} AS b FROM s WHERE t1 > {T_FROM} AND t < {T_TO}),
x AS (SELECT run, sig, i, a < 0 AS rises, t - a * (t1 - t) / (b - a) AS x FROM c WHERE (a < 0 AND b >= 0) OR (a > 0 AND b <= 0)),
y AS (SELECT * FROM x WHERE x >= {T_FROM} - 1e-15 AND x <= {T_TO} + 1e-15)
"""


@query("win2_crossings", CROSS + "SELECT run, sig, i, round(x, 4) AS x FROM y")
def win2(spark, sf):
    return S.crossings(waves(spark, sf), LEVEL, "cross", T_FROM, T_TO).select("run", "sig", "i", rounded("x", 4))


@query("win2_crossings_rise", CROSS + "SELECT run, sig, i, round(x, 4) AS x FROM y WHERE rises")
def win2_rise(spark, sf):
    return S.crossings(waves(spark, sf), LEVEL, "rise", T_FROM, T_TO).select("run", "sig", "i", rounded("x", 4))


@query(
    "win3_nth_crossing",
    CROSS + """SELECT run, sig, CAST(3 AS INTEGER) AS nth, round(x, 4) AS x FROM
    (SELECT *, row_number() OVER (PARTITION BY run, sig ORDER BY i) AS r FROM y WHERE NOT rises) WHERE r = 3""",
)
def win3(spark, sf):
    return S.nth_crossing(waves(spark, sf), LEVEL, 3, "fall", T_FROM, T_TO).select("run", "sig", "nth", rounded("x", 4))


@query(
    "win3_nth_crossing_split_keys",
    CROSS + """SELECT run, sig, CAST(3 AS INTEGER) AS nth, round(x, 4) AS x FROM
    (SELECT *, row_number() OVER (PARTITION BY run, sig ORDER BY i) AS r FROM y WHERE NOT rises) WHERE r = 3""",
)
def win3_split(spark, sf):
    w = waves(spark, sf)
    return S.nth_crossing(w, LEVEL, 3, "fall", T_FROM, T_TO, rows_per_chunk=60).select("run", "sig", "nth", rounded("x", 4))


@query(
    "win4_when",
    CROSS + """, f AS (SELECT run, sig, x, row_number() OVER (PARTITION BY run, sig ORDER BY i) AS r FROM y WHERE rises)
    SELECT k.run, k.sig AS name, round(f.x, 4) AS value, CASE WHEN f.x IS NULL THEN 'the condition never occurred in the window' END AS error
    FROM (SELECT DISTINCT run, sig FROM w) k LEFT JOIN f ON f.run = k.run AND f.sig = k.sig AND f.r = 2""",
)
def win4(spark, sf):
    specs = [M.Spec(x, "when", x, level=LEVEL, edge="rise", nth=2, **WINDOW) for x in SIGNALS]
    return M.measure(waves(spark, sf), specs).select("run", "name", rounded("value", 4), "error")


DIFF = PRE2 + """, d AS (SELECT run, i, t, "out" - ref AS v FROM ww),
s AS (SELECT *, lead(t) OVER k AS t1, lead(v) OVER k AS v1 FROM d WINDOW k AS (PARTITION BY run ORDER BY t, i)),
x AS (SELECT run, i, t - v * (t1 - t) / (v1 - v) AS x, v < 0 AS rises FROM s
      WHERE t1 > t AND ((v < 0 AND v1 >= 0) OR (v > 0 AND v1 <= 0))),
f AS (SELECT run, i, x, row_number() OVER (PARTITION BY run ORDER BY i) AS r FROM x WHERE rises)
"""


@query(
    "win5_when_signals",
    DIFF + """SELECT k.run, round(f.x, 4) AS value, CASE WHEN f.x IS NULL THEN 'the condition never occurred in the window' END AS error
    FROM (SELECT DISTINCT run FROM ww) k LEFT JOIN f ON f.run = k.run AND f.r = 5""",
)
def win5(spark, sf):
    got = M.measure_when(two_signals(spark, sf), "out", other="ref", edge="rise", nth=5)
    return got.select("run", rounded("value", 4), "error")


@query(
    "win6_find_when",
    PRE2 + """, o AS (SELECT run, i, t, "out" AS a, lead("out") OVER k AS a1, ref AS b, lead(ref) OVER k AS b1, lead(t) OVER k AS t1
                     FROM ww WINDOW k AS (PARTITION BY run ORDER BY t, i)),
    x AS (SELECT *, t - (b - 50) * (t1 - t) / (b1 - b) AS x FROM o WHERE t1 > t AND ((b < 50 AND b1 >= 50) OR (b > 50 AND b1 <= 50))),
    f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i) AS r FROM x)
    SELECT run, round(a + (a1 - a) * (x - t) / (t1 - t), 5) AS value FROM f WHERE r = 4""",
)
def win6(spark, sf):
    got = M.measure_find_when(two_signals(spark, sf), "out", other="ref", level=50.0, nth=4)
    return got.select("run", rounded("value", 5))


@query(
    "win7_delay",
    CROSS + """, f AS (SELECT run, sig, x, row_number() OVER (PARTITION BY run, sig ORDER BY i) AS r FROM y WHERE rises)
    SELECT k.run, round(b.x - a.x, 4) AS value,
           CASE WHEN a.x IS NULL THEN 'the first crossing is not there' WHEN b.x IS NULL THEN 'the second crossing is not there' END AS error
    FROM (SELECT DISTINCT run FROM w) k LEFT JOIN f a ON a.run = k.run AND a.sig = 'click' AND a.r = 1
    LEFT JOIN f b ON b.run = k.run AND b.sig = 'view' AND b.r = 3""",
)
def win7(spark, sf):
    trig = {"sig": "click", "level": LEVEL, "edge": "rise", "nth": 1}
    targ = {"sig": "view", "level": LEVEL, "edge": "rise", "nth": 3}
    got = M.measure_delay(waves(spark, sf), trig, targ, T_FROM, T_TO)
    return got.select("run", rounded("value", 4), "error")


@query(
    "win8_deriv",
    PRE + """, h AS (SELECT run, sig, arg_max((v1 - v) / (t1 - t), (t, i)) AS d FROM s WHERE t1 > t AND t < 1500000.0 GROUP BY run, sig)
    SELECT run, sig AS name, round(d, 6) AS value FROM h""",
)
def win8(spark, sf):
    return _each(spark, sf, "deriv", at=1500000.0)


@query(
    "win9_measure_all",
    PRE + f""", b AS (SELECT run, sig, count(*) AS n, min(t) AS t0, max(t) AS tn, arg_max(v, (t, i)) AS final FROM w GROUP BY run, sig),
    m AS (SELECT run, sig, max(v) AS hi FROM w WHERE t >= {T_FROM} AND t <= {T_TO} GROUP BY run, sig),
    r AS (SELECT DISTINCT run FROM w)
    SELECT run, 'top_view' AS name, 'max' AS func, hi AS value, NULL AS unit, NULL AS error FROM m WHERE sig = 'view'
    UNION ALL SELECT run, 'last_click', 'final', final, NULL, NULL FROM b WHERE sig = 'click'
    UNION ALL SELECT run, 'nobody', 'avg', NULL, NULL, 'unknown signal: nobody' FROM r
    UNION ALL SELECT run, 'odd', 'median', NULL, NULL, 'measurement not implemented: median' FROM r
    UNION ALL SELECT run, 'late', 'avg', NULL, NULL, 'no samples between the window''s ends' FROM r
    UNION ALL SELECT run, 'never', 'when', NULL, NULL, 'the condition never occurred in the window' FROM r""",
)
def win9(spark, sf):
    specs = [
        M.Spec("top_view", "max", "VIEW", **WINDOW),
        M.Spec("last_click", "final", "click"),
        M.Spec("nobody", "avg", "nobody"),
        M.Spec("odd", "median", "view"),
        M.Spec("late", "avg", "view", t_from=9e9, t_to=9.1e9),
        M.Spec("never", "when", "view", level=1e9),
    ]
    return M.measure(waves(spark, sf), specs)


@query(
    "win9_spec_table",
    PRE + """, u AS (SELECT user_id, event_id AS i, t, value AS v FROM events JOIN (SELECT i, t FROM w) x ON x.i = event_id),
    b AS (SELECT user_id, count(*) AS n, min(t) AS t0, max(t) AS tn, max(v) AS hi, min(v) AS lo, arg_max(v, (t, i)) AS final FROM u GROUP BY user_id),
    c AS (SELECT c_name AS name, 'U' || c_custkey AS sig, c_custkey % 4 AS k, b.* FROM customer LEFT JOIN b ON user_id = c_custkey)
    SELECT name, CASE k WHEN 0 THEN 'max' WHEN 1 THEN 'pp' WHEN 2 THEN 'final' ELSE 'median' END AS func,
      CASE WHEN k = 2 THEN final WHEN k < 2 AND n >= 2 AND tn > t0 THEN CASE k WHEN 0 THEN hi ELSE round(hi - lo, 6) END END AS value,
      CASE WHEN k = 3 THEN 'measurement not implemented: median' WHEN n IS NULL THEN 'unknown signal: ' || sig
        WHEN k < 2 AND n < 2 THEN 'a measurement needs at least two points' WHEN k < 2 AND NOT tn > t0 THEN 'no samples between the window''s ends' END AS error FROM c""",
)
def win9_table(spark, sf):
    """A measurement per customer, each of a signal of its own; the table is joined, never read by the driver."""
    e = table(spark, sf, "events")
    w = W.waves_from_events(
        e.withColumn("sig", F.concat(F.lit("u"), F.col("user_id").cast("string"))), "ts", "sig", "value", F.lit(1).cast("long"), "event_id"
    )
    k = F.col("c_custkey") % 4
    specs = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        F.when(k == 0, "max").when(k == 1, "pp").when(k == 2, "final").otherwise("median").alias("func"),
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("sig"),
    )
    return M.measure(w, specs).select("name", "func", rounded("value"), "error")


@query(
    "flt1_window",
    PRE + f""", b AS (SELECT run, sig, min(t) AS t0, max(t) AS tn FROM w GROUP BY run, sig)
    SELECT run, sig, round(greatest({T_FROM}, t0), 6) AS lo, round(least(9e9, tn), 6) AS hi, CAST(NULL AS VARCHAR) AS error FROM b""",
)
def flt1(spark, sf):
    return M.window_of(waves(spark, sf), T_FROM, 9e9).select("run", "sig", rounded("lo"), rounded("hi"), "error")


@query(
    "flt1_window_refused",
    PRE + "SELECT DISTINCT run, sig, 'no samples between the window''s ends' AS error FROM w",
)
def flt1_refused(spark, sf):
    return M.window_of(waves(spark, sf), 2.0, 1.0).select("run", "sig", "error")


@query(
    "prj10_capture",
    PRE + "SELECT run, sig, i, v FROM w WHERE sig IN ('click', 'view')",
)
def prj10(spark, sf):
    specs = [M.Spec("a", "avg", "Click"), M.Spec("b", "trig", "view", other="CLICK", level=1.0, level2=2.0)]
    return M.capture(waves(spark, sf), specs).select("run", "sig", "i", "v")


# ------------------------------------------------------------------ joins

POINTS = ", p AS (SELECT run, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS sig, i AS pid, t + 1000 AS x FROM w)"


def _points(w):
    every = F.explode(F.array(*[F.lit(s) for s in SIGNALS])).alias("sig")
    return w.select("run", every, F.col("i").alias("pid"), (F.col("t") + 1000).alias("x"))


ASOF = PRE + POINTS + """, g AS (SELECT run, sig, t, v, t1, v1 FROM s WHERE t1 IS NOT NULL),
f AS (SELECT run, sig, min(t) AS ft FROM g GROUP BY run, sig),
h AS (SELECT p.run, p.sig, p.pid, p.x, g.t, g.v, g.t1, g.v1 FROM p JOIN f ON p.run = f.run AND p.sig = f.sig
      ASOF LEFT JOIN g ON p.run = g.run AND p.sig = g.sig AND p.x > g.t WHERE p.x > f.ft
      UNION ALL SELECT p.run, p.sig, p.pid, p.x, g.t, g.v, g.t1, g.v1 FROM p JOIN f ON p.run = f.run AND p.sig = f.sig
      JOIN g ON g.run = p.run AND g.sig = p.sig AND g.t = f.ft WHERE p.x <= f.ft)
SELECT run, sig, pid, round(v + (v1 - v) * (x - t) / (t1 - t), 4) AS v, x < t OR x > t1 AS extrapolated FROM h
"""


@query("join1_value_at", ASOF)
def join1(spark, sf):
    w = waves(spark, sf)
    return M.value_at(w, _points(w)).select("run", "sig", "pid", rounded("v", 4), "extrapolated")


@query("join1_value_at_split_keys", ASOF)
def join1_split(spark, sf):
    w = waves(spark, sf)
    return M.value_at(w, _points(w), rows_per_chunk=50).select("run", "sig", "pid", rounded("v", 4), "extrapolated")


@query(
    "join2_nearest",
    PRE + POINTS + """, b AS (SELECT p.*, w.t AS tb, w.v AS vb FROM p ASOF LEFT JOIN w ON p.run = w.run AND p.sig = w.sig AND p.x > w.t),
    a AS (SELECT b.*, w.t AS ta, w.v AS va FROM b ASOF LEFT JOIN w ON b.run = w.run AND b.sig = w.sig AND b.x <= w.t)
    SELECT run, sig, pid, CASE WHEN ta IS NULL OR x - tb <= ta - x THEN vb ELSE va END AS v FROM a""",
)
def join2(spark, sf):
    w = waves(spark, sf)
    return M.nearest(w, _points(w)).select("run", "sig", "pid", "v")


FEW = ", p AS (SELECT run, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS sig, n_nationkey AS pid, n_nationkey * 110000.0 + run - 5000 AS x FROM nation, (SELECT DISTINCT run FROM w))"


def _few_points(spark, sf):
    """An instant per nation, run and signal; some lie outside the data."""
    run = F.explode(F.array(*[F.lit(k).cast("long") for k in range(8)])).alias("run")
    sig = F.explode(F.array(*[F.lit(s) for s in SIGNALS])).alias("sig")
    n = table(spark, sf, "nation").select("n_nationkey", run).select("n_nationkey", "run", sig)
    x = F.col("n_nationkey") * F.lit(110000.0) + F.col("run") - 5000
    return n.select("run", "sig", F.col("n_nationkey").alias("pid"), x.alias("x"))


@query(
    "join1_value_at_few",
    PRE + FEW + """, g AS (SELECT run, sig, t, v, t1, v1 FROM s WHERE t1 IS NOT NULL),
    h AS (SELECT p.run, p.sig, pid, x, max(CASE WHEN t < x THEN (t, v, t1, v1) END) AS hit, min((t, v, t1, v1)) AS first FROM p JOIN g USING (run, sig) GROUP BY ALL),
    k AS (SELECT run, sig, pid, x, unnest(coalesce(hit, first), recursive := FALSE) AS q FROM (SELECT * REPLACE ([hit] AS hit, [first] AS first) FROM h WHERE hit IS NOT NULL UNION ALL SELECT * REPLACE ([first] AS hit, [first] AS first) FROM h WHERE hit IS NULL))
    SELECT run, sig, CAST(pid AS INTEGER) AS pid, round(q[2] + (q[4] - q[2]) * (x - q[1]) / (q[3] - q[1]), 3) AS v, x < q[1] OR x > q[3] AS extrapolated FROM k""",
)
def join1_few(spark, sf):
    points = _few_points(spark, sf)
    return M.value_at_few(waves(spark, sf), points).select("run", "sig", F.col("pid").cast("int").alias("pid"), rounded("v", 3), "extrapolated")


@query(
    "join2_nearest_few",
    PRE + FEW + """SELECT p.run, p.sig, CAST(pid AS INTEGER) AS pid, arg_min(v, (abs(t - x), i)) AS v FROM p JOIN w USING (run, sig) GROUP BY ALL""",
)
def join2_few(spark, sf):
    points = _few_points(spark, sf)
    return M.nearest_few(waves(spark, sf), points).select("run", "sig", F.col("pid").cast("int").alias("pid"), "v")


SHIFTED = ", b AS (SELECT run, sig, i, t + 5 AS t, v * (1 + (i % 7) * 0.001) AS v FROM w)"
DIFFED = PRE + SHIFTED + """, l AS (SELECT b.run, b.sig, b.i, b.t AS x, b.v AS vb, w.t AS tl, w.v AS vl FROM b ASOF LEFT JOIN w ON b.run = w.run AND b.sig = w.sig AND b.t > w.t),
r AS (SELECT l.*, w.t AS tr, w.v AS vr FROM l ASOF LEFT JOIN w ON l.run = w.run AND l.sig = w.sig AND l.x <= w.t),
d AS (SELECT run, sig, i, x, vb, CASE WHEN tr IS NULL OR x - tl <= tr - x THEN vl ELSE vr END AS va FROM r),
q AS (SELECT *, abs(va - vb) AS abs_err, abs(va - vb) / abs(vb) AS rel_err, abs(va - vb) <= greatest(1e-12, 0.0045 * abs(vb)) AS ok FROM d WHERE abs(vb) >= 1.0)
"""


def _diff(spark, sf):
    w = waves(spark, sf)
    b = w.withColumn("t", F.col("t") + 5).withColumn("v", F.col("v") * (1 + (F.col("i") % 7) * 0.001))
    return compare.diff_runs(w, b, rtol=0.0045, floor=1.0)


@query("join7_diff_runs", DIFFED + "SELECT run, sig, i, round(va, 6) AS a, round(abs_err, 6) AS abs_err, round(rel_err, 6) AS rel_err, ok FROM q")
def join7(spark, sf):
    return _diff(spark, sf).select("run", "sig", "i", rounded("a"), rounded("abs_err"), rounded("rel_err"), "ok")


@query(
    "agg21_worst_error",
    DIFFED + "SELECT run, sig, count(*) AS n, count(*) FILTER (NOT ok) AS failed, round(max(rel_err), 6) AS worst FROM q GROUP BY run, sig",
)
def agg21(spark, sf):
    return compare.worst_error(_diff(spark, sf)).select("run", "sig", "n", "failed", rounded("worst"))


@query(
    "join7_diff_runs_unit",
    DIFFED + "SELECT run, sig, i, round(va, 6) AS a, abs(va - vb) <= 0.0045 * greatest(abs(vb), 1.0) AS ok FROM q",
)
def join7_unit(spark, sf):
    w = waves(spark, sf)
    b = w.withColumn("t", F.col("t") + 5).withColumn("v", F.col("v") * (1 + (F.col("i") % 7) * 0.001))
    return compare.diff_runs(w, b, rtol=0.0045, floor=1.0, relative_to="unit").select("run", "sig", "i", rounded("a"), "ok")


# every 97th sample of ours is no number
GAPS = "CASE WHEN {i} % 97 = 0 THEN NULL ELSE {v} END"


def _gaps(df):
    return df.withColumn("v", W.clean(F.when(F.col("i") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("v"))))


@query(
    "join7_diff_runs_missing",
    DIFFED.replace("w.v AS vl", GAPS.format(i="w.i", v="w.v") + " AS vl").replace("w.v AS vr", GAPS.format(i="w.i", v="w.v") + " AS vr")
    + "SELECT run, sig, i, round(va, 6) AS a, coalesce(ok, FALSE) AS ok, va IS NULL AS missing FROM q",
)
def join7_missing(spark, sf):
    w = waves(spark, sf)
    b = w.withColumn("t", F.col("t") + 5).withColumn("v", F.col("v") * (1 + (F.col("i") % 7) * 0.001))
    found = compare.diff_runs(_gaps(w), b, rtol=0.0045, floor=1.0)
    return found.select("run", "sig", "i", rounded("a"), "ok", "missing")


@query(
    "agg21_worst_error_missing",
    DIFFED.replace("w.v AS vl", GAPS.format(i="w.i", v="w.v") + " AS vl").replace("w.v AS vr", GAPS.format(i="w.i", v="w.v") + " AS vr")
    + """SELECT run, sig, count(*) AS n, count(*) FILTER (NOT coalesce(ok, FALSE)) AS failed,
    CASE WHEN count(va) < count(*) THEN CAST('inf' AS DOUBLE) ELSE round(max(rel_err), 6) END AS worst FROM q GROUP BY run, sig""",
)
def agg21_missing(spark, sf):
    w = waves(spark, sf)
    b = w.withColumn("t", F.col("t") + 5).withColumn("v", F.col("v") * (1 + (F.col("i") % 7) * 0.001))
    found = compare.diff_runs(_gaps(w), b, rtol=0.0045, floor=1.0)
    return compare.worst_error(found).select("run", "sig", "n", "failed", rounded("worst"))


@query(
    "agg2_avg_missing",
    PRE + f""", g AS (SELECT run, sig, count(*) FILTER (t1 > {T_FROM} AND t < {T_TO} AND (i % 97 = 0 OR i1 % 97 = 0)) AS gaps
    FROM (SELECT *, lead(i) OVER (PARTITION BY run, sig ORDER BY t, i) AS i1 FROM s) GROUP BY run, sig)
    SELECT run, sig AS name, CASE WHEN gaps > 0 THEN 'samples are missing in the window' END AS error FROM g""",
)
def agg2_missing(spark, sf):
    specs = [M.Spec(x, "avg", x, **WINDOW) for x in SIGNALS]
    return M.measure(_gaps(waves(spark, sf)), specs).select("run", "name", "error")


@query(
    "win16_decimate",
    PRE + """, z AS (SELECT run, sig, i, t, v, n, row_number() OVER (PARTITION BY run, sig ORDER BY t, i) - 1 AS r FROM s),
    y AS (SELECT *, greatest(CAST(ceil(n / 40.0) AS BIGINT), 1) AS step FROM z)
    SELECT run, sig, CASE WHEN r = n - 1 THEN (n - 1) // step ELSE r // step END AS slot, i, v FROM y
    WHERE r = n - 1 OR (r % step = 0 AND r // step < (n - 1) // step)""",
)
def win16(spark, sf):
    return S.decimate(waves(spark, sf), 40).select("run", "sig", "slot", "i", "v")


# ------------------------------------------------------------------ probes

PROBES = [
    probes.Probe("p1", "voltage", "OUT"),
    probes.Probe("p2", "differential", "out", "ref"),
    probes.Probe("p3", "voltage", "GND"),
    probes.Probe("p4", "differential", "ref", "0"),
]


@query(
    "prj1_prj2_probes",
    PRE2 + """SELECT run, 'p1' AS id, i, round(t, 6) AS t, "out" AS v, 'V' AS unit FROM ww
    UNION ALL SELECT run, 'p2', i, round(t, 6), round("out" - ref, 6), 'V' FROM ww
    UNION ALL SELECT run, 'p3', i, round(t, 6), 0.0, 'V' FROM ww
    UNION ALL SELECT run, 'p4', i, round(t, 6), ref, 'V' FROM ww""",
)
def prj1(spark, sf):
    return probes.resolve_probes(two_signals(spark, sf), PROBES).select("run", "id", "i", rounded("t"), rounded("v"), "unit")


@query(
    "prj1_probe_table",
    PRE2 + """SELECT run, n_name AS id, i, CASE n_nationkey % 4 WHEN 0 THEN "out" WHEN 1 THEN round("out" - ref, 6) WHEN 2 THEN ref ELSE 0.0 END AS v, 'V' AS unit FROM ww, nation""",
)
def prj1_table(spark, sf):
    """Probes that come as a table: a voltage, a difference, one against ground, and ground itself."""
    k = F.col("n_nationkey") % 4
    p = table(spark, sf, "nation").select(
        F.col("n_name").alias("id"),
        F.when(k.isin(1, 2), "differential").alias("kind"),
        F.when(k == 3, "GND").when(k == 2, "Ref").otherwise("OUT").alias("target"),
        F.when(k == 1, "ref").when(k == 2, "0").alias("target2"),
    )
    return probes.resolve_probes(two_signals(spark, sf), p).select("run", "id", "i", rounded("v"), "unit")


@query(
    "prj4_probe_table_status",
    PRE2 + """SELECT run, s_name AS id, 'I(' || s_name || ')' AS label, FALSE AS ok, 'no branch current: ' || s_name AS reason FROM supplier, (SELECT DISTINCT run FROM ww) WHERE s_nationkey % 3 = 0
    UNION ALL SELECT run, s_name, 'V(out)', TRUE, NULL FROM supplier, (SELECT DISTINCT run FROM ww) WHERE s_nationkey % 3 = 1
    UNION ALL SELECT run, s_name, 'V(out,' || s_name || ')', FALSE, 'no such net: ' || s_name FROM supplier, (SELECT DISTINCT run FROM ww) WHERE s_nationkey % 3 = 2""",
)
def prj4_table(spark, sf):
    k = F.col("s_nationkey") % 3
    p = table(spark, sf, "supplier").select(
        F.col("s_name").alias("id"), F.when(k == 0, "current").when(k == 2, "differential").alias("kind"),
        F.when(k == 0, F.col("s_name")).otherwise("out").alias("target"), F.col("s_name").alias("target2"),
    )
    return probes.probe_status(two_signals(spark, sf), p)


@query(
    "prj3_prj5_current_probe",
    PRE2 + """SELECT run, 'c1' AS id, i, "out" AS v, 'A' AS unit FROM ww""",
)
def prj3(spark, sf):
    """The signal comes labelled ``v1#branch`` and is read as ``I(v1)``."""
    w = two_signals(spark, sf).where(F.col("sig") == "out").withColumn("sig", normalize_label(F.lit("v1#branch")))
    return probes.resolve_probes(w, [probes.Probe("c1", "current", "V1")]).select("run", "id", "i", "v", "unit")


@query(
    "prj4_probe_status",
    PRE2 + """, r AS (SELECT DISTINCT run FROM ww)
    SELECT run, 'p1' AS id, 'V(OUT)' AS label, TRUE AS ok, CAST(NULL AS VARCHAR) AS reason FROM r
    UNION ALL SELECT run, 'p5', 'V(out,lost)', FALSE, 'no such net: lost' FROM r
    UNION ALL SELECT run, 'p6', 'coil', FALSE, 'no branch current: L1' FROM r""",
)
def prj4(spark, sf):
    asked = [PROBES[0], probes.Probe("p5", "differential", "out", "lost"), probes.Probe("p6", "current", "L1", label="coil")]
    return probes.probe_status(two_signals(spark, sf), asked)


@query(
    "prj7_probe_label",
    """SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'V(' || s_name || ')' WHEN 1 THEN 'I(' || s_name || ')'
       ELSE 'V(' || s_name || ',' || CAST(s_nationkey AS VARCHAR) || ')' END AS label FROM supplier""",
)
def prj7(spark, sf):
    s = table(spark, sf, "supplier")
    kind = F.element_at(F.array(F.lit("voltage"), F.lit("current"), F.lit("differential")), F.col("s_nationkey") % 3 + 1)
    p = s.select("s_suppkey", kind.alias("kind"), F.col("s_name").alias("target"), F.col("s_nationkey").cast("string").alias("target2"))
    return p.select("s_suppkey", probes.probe_label().alias("label"))


@query(
    "prj8_routed",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label FROM customer
       WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def prj8(spark, sf):
    c = table(spark, sf, "customer")
    p = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"), (F.col("c_acctbal") >= 0).alias("enabled"))
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("instrument"), F.col("o_custkey").cast("string").alias("probe_id"))
    return probes.routed(p, r, "1-URGENT").select("id", "label")


@query(
    "set2_distinct_signals",
    PRE + "SELECT DISTINCT run, sig FROM w",
)
def set2(spark, sf):
    return waves(spark, sf).select("run", "sig").distinct()
