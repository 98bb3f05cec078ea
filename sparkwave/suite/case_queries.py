"""Case tables: grids and draws per part, summaries over lineitem."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkwave.functions import draws as D
from sparkwave.functions import grids as G
from sparkwave.operators import cases as K
from sparkwave.sources import synth
from sparkwave.suite.registry import query, rounded, table


def results(spark, sf):
    """Each line as a case: failed where its status is O, not a number where its tax is zero."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("name"),
        ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 10)).alias("ok"),
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_extendedprice")).alias("value"),
    )


GOOD = """
WITH g AS (SELECT l_returnflag AS name, l_extendedprice AS value FROM lineitem WHERE (l_linestatus = 'F' OR l_quantity > 10) AND l_tax <> 0)
"""
SUMMARY = GOOD + """, k AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY name) AS n FROM g),
a AS (SELECT name, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM g GROUP BY name),
q AS (SELECT name, max(value) FILTER (r = floor(0.01 * (n - 1) + 0.5)) AS p1, max(value) FILTER (r = floor(0.5 * (n - 1) + 0.5)) AS p50,
             max(value) FILTER (r = floor(0.99 * (n - 1) + 0.5)) AS p99 FROM k GROUP BY name)
SELECT a.name, a.n, round(a.mean, 4) AS mean, round(a.sd, 4) AS sd, a.min, a.max, q.p1, q.p50, q.p99 FROM a JOIN q USING (name)
"""


@query("flt2_finite_ok", GOOD + "SELECT name, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY name")
def flt2(spark, sf):
    return K.finite_ok(results(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2, "total"))


@query("agg16_summarize", SUMMARY)
def agg16(spark, sf):
    s = K.summarize(results(spark, sf))
    return s.select("name", "n", rounded("mean", 4), rounded("sd", 4), "min", "max", "p1", "p50", "p99")


@query("agg16_summarize_split_names", SUMMARY)
def agg16_split(spark, sf):
    """The same with each name's values cut into pieces."""
    s = K.summarize(results(spark, sf), rows_per_chunk=1000)
    return s.select("name", "n", rounded("mean", 4), rounded("sd", 4), "min", "max", "p1", "p50", "p99")


# ------------------------------------------------------------------ draws

# the generator in wide integers
DRAW = """
WITH RECURSIVE base AS (SELECT {seed} AS seed, {draw} AS d, {cols} FROM {source}),
m1 AS (SELECT *, CAST((CAST(seed AS HUGEINT) + (CAST(d AS HUGEINT) + 1) * 1831565813) % 4294967296 AS BIGINT) AS a FROM base),
m2 AS (SELECT *, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * CAST((a | 1) AS HUGEINT)) % 4294967296 AS BIGINT) AS t FROM m1),
m3 AS (SELECT *, xor(t, CAST((CAST(t AS HUGEINT) + (CAST(xor(t, t >> 7) AS HUGEINT) * CAST((t | 61) AS HUGEINT)) % 4294967296) % 4294967296 AS BIGINT)) AS u FROM m2),
m AS (SELECT *, xor(u, u >> 14) / 4294967296.0 AS x FROM m3)
"""


def _draw(seed: str, draw: str, cols: str, source: str) -> str:
    return DRAW.replace("WITH RECURSIVE", "WITH").format(seed=seed, draw=draw, cols=cols, source=source)


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("mc1_uniform", _draw("l_partkey", "l_orderkey", LINE, "lineitem") + f"SELECT {LINE}, x FROM m")
def mc1(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LINE.split(", "), D.uniform("l_partkey", "l_orderkey").alias("x"))


PAIR = _draw("7", "q.k", "p_partkey, k", "(SELECT p_partkey, p_partkey * 2 + j AS k, j FROM part, (SELECT unnest([0, 1]) AS j)) q")


@query(
    "mc2_gauss",
    PAIR + """, g AS (SELECT p_partkey, max(x) FILTER (k % 2 = 0) AS u, max(x) FILTER (k % 2 = 1) AS w FROM m GROUP BY p_partkey)
    SELECT p_partkey, round(sqrt(-2 * ln(u)) * cos(2 * pi() * w), 6) + 0.0 AS z FROM g""",
)
def mc2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rounded(D.gauss(F.lit(7), "p_partkey"), 6, "z"))


THREE = _draw("3", "q.k", "p_partkey, p_retailprice, p_size, j", "(SELECT p_partkey, p_retailprice, p_size, p_partkey * 3 + j AS k, j FROM part, (SELECT unnest([0, 1, 2]) AS j)) q")
MC = THREE + """, s AS (SELECT p_partkey AS case_id, any_value(p_retailprice) AS r0, any_value(p_size) AS c0,
    max(x) FILTER (j = 0) AS u, max(x) FILTER (j = 1) AS w, max(x) FILTER (j = 2) AS q FROM m GROUP BY p_partkey),
o AS (SELECT case_id, r0 * (1 + 0.05 / 3 * sqrt(-2 * ln(u)) * cos(2 * pi() * w)) AS r, c0 * (1 + 0.1 * (q * 2 - 1)) AS c FROM s)
"""


def cases(spark, sf):
    """A toleranced resistance and capacitance for every part, three draws each."""
    p = table(spark, sf, "part")
    first = F.col("p_partkey") * 3
    return p.select(
        F.col("p_partkey").alias("case_id"),
        F.create_map(
            F.lit("r"), D.toleranced("p_retailprice", F.lit(0.05), "gauss", F.lit(3), first),
            F.lit("c"), D.toleranced("p_size", F.lit(0.1), "uniform", F.lit(3), first + 2),
        ).alias("params"),
    )


@query("mc3_tolerance_samples", MC + "SELECT case_id, round(r, 5) AS r, round(c, 6) AS c FROM o")
def mc3(spark, sf):
    return cases(spark, sf).select("case_id", rounded(K.param("r"), 5, "r"), rounded(K.param("c"), 6, "c"))


TRIALS = _draw("5", "q.k", "case_id, j", "(SELECT case_id, case_id * 3 + j AS k, j FROM (SELECT unnest(range((SELECT count(*) FROM part))) AS case_id), (SELECT unnest([0, 1, 2]) AS j)) q") + """, s AS (SELECT case_id,
    max(x) FILTER (j = 0) AS u, max(x) FILTER (j = 1) AS w, max(x) FILTER (j = 2) AS q FROM m GROUP BY case_id),
o AS (SELECT case_id, 1000 * (1 + 0.05 / 3 * sqrt(-2 * ln(u)) * cos(2 * pi() * w)) AS r, 40 * (1 + 0.2 * (q * 2 - 1)) AS c FROM s)
"""
SPEC = [("r", 1000.0, 0.05, "gauss"), ("c", 40.0, 0.2, "uniform")]


@query("mc3_sample_sets", TRIALS + "SELECT case_id, round(r, 5) AS r, round(c, 6) AS c FROM o")
def mc3_sets(spark, sf):
    """As many trials as there are parts."""
    made = K.sample_sets(spark, SPEC, table(spark, sf, "part").count(), seed=5)
    return made.select("case_id", rounded(K.param("r"), 5, "r"), rounded(K.param("c"), 6, "c"))


@query(
    "mc5_monte_carlo_run",
    TRIALS + """, e AS (SELECT r * c AS value FROM o WHERE c <= 45), k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM e)
    SELECT 'tau' AS name, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS sd,
    round(max(value) FILTER (r = floor(0.01 * (n - 1) + 0.5)), 3) AS p1, round(max(value) FILTER (r = floor(0.5 * (n - 1) + 0.5)), 3) AS p50,
    round(max(value) FILTER (r = floor(0.99 * (n - 1) + 0.5)), 3) AS p99 FROM k""",
)
def mc5_run(spark, sf):
    guard = F.when(K.param("c") > 45, F.lit("capacitance out of range"))
    trials = table(spark, sf, "part").count()
    _, s = K.monte_carlo(spark, SPEC, trials, 5, {"tau": K.param("r") * K.param("c")}, guard)
    return s.select("name", "n", *[rounded(c, 3) for c in ("mean", "sd", "p1", "p50", "p99")])


FAILED = "CASE WHEN c > 45 THEN 'capacitance out of range' END"


def evaluated(spark, sf):
    r, c = K.param("r"), K.param("c")
    guard = F.when(c > 45, F.lit("capacitance out of range"))
    return K.evaluate_cases(cases(spark, sf), {"tau": r * c, "corner": 1 / (2 * math.pi * r * c)}, guard)


@query(
    "mc4_evaluate_cases",
    MC + f""", e AS (SELECT *, {FAILED} AS error FROM o)
    SELECT case_id, error IS NULL AS ok, error, 'tau' AS name, CASE WHEN error IS NULL THEN round(r * c, 3) END AS value FROM e
    UNION ALL SELECT case_id, error IS NULL, error, 'corner', CASE WHEN error IS NULL THEN round(1 / (2 * pi() * r * c), 9) END FROM e""",
)
def mc4(spark, sf):
    e = evaluated(spark, sf)
    value = F.when(F.col("name") == "tau", F.round("value", 3)).otherwise(F.round("value", 9))
    return e.select("case_id", "ok", "error", "name", value.alias("value"))


@query(
    "mc5_monte_carlo",
    MC + """, e AS (SELECT r * c AS value FROM o WHERE c <= 45), k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM e)
    SELECT 'tau' AS name, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS sd,
    round(max(value) FILTER (r = floor(0.01 * (n - 1) + 0.5)), 3) AS p1, round(max(value) FILTER (r = floor(0.5 * (n - 1) + 0.5)), 3) AS p50,
    round(max(value) FILTER (r = floor(0.99 * (n - 1) + 0.5)), 3) AS p99 FROM k""",
)
def mc5(spark, sf):
    s = K.summarize(evaluated(spark, sf), ["tau"])
    return s.select("name", "n", rounded("mean", 3), rounded("sd", 3), rounded("p1", 3), rounded("p50", 3), rounded("p99", 3))


@query(
    "prj9_apply_overrides",
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_size > 25 THEN p_retailprice ELSE 1.0 END AS price, CAST(2 AS DOUBLE) AS extra FROM part",
)
def prj9(spark, sf):
    p = table(spark, sf, "part")
    none = F.create_map().cast("map<string,double>")
    base = p.select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.lit(1.0)).alias("params"))
    over = p.select(
        "p_partkey",
        K.override_map(
            F.create_map(F.lit("extra"), F.lit(2.0)),
            F.when(F.col("p_size") > 25, F.create_map(F.lit("price"), F.col("p_retailprice"))).otherwise(none),
        ).alias("params"),
    )
    m = K.apply_overrides(base, over, ["p_partkey"])
    return m.select("p_partkey", *[F.col("params")[n].alias(n) for n in ("size", "price", "extra")])


# ------------------------------------------------------------------ grids


def _grid(spark, sf, column, digits=6):
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(column).alias("k", "x"))
    return p.select("p_partkey", "k", rounded("x", digits))


def _grid_sql(count: str, value: str, digits: int = 6) -> str:
    return f"SELECT p_partkey, CAST(k AS INTEGER) AS k, round({value}, {digits}) + 0.0 AS x FROM (SELECT *, unnest(range({count})) AS k FROM part)"


@query("grd1_range", _grid_sql("CAST(floor(abs((p_size - 20.0) / 3.5) + 1e-9) AS BIGINT) + 1", "20.0 + CASE WHEN p_size >= 20 THEN 1 ELSE -1 END * k * 3.5"))
def grd1(spark, sf):
    return _grid(spark, sf, G.grid_range(F.lit(20.0), "p_size", F.lit(-3.5)))


@query("grd2_log_decades", _grid_sql("CAST(ceil(ln(p_retailprice / p_size) / ln(10.0) * 4) AS BIGINT) + 1", "p_size * exp(ln(10.0) * k / 4)", 4))
def grd2(spark, sf):
    return _grid(spark, sf, G.grid_log("dec", F.lit(4), "p_size", "p_retailprice"), 4)


@query("grd2_log_octaves", _grid_sql("CAST(ceil(ln(p_retailprice / p_size) / ln(2.0) * 3) AS BIGINT) + 1", "p_size * exp(ln(2.0) * k / 3)", 4))
def grd2_oct(spark, sf):
    return _grid(spark, sf, G.grid_log("oct", F.lit(3), "p_size", "p_retailprice"), 4)


@query("grd3_lin_points", _grid_sql("p_size", "CASE WHEN p_size > 1 THEN k * (100.0 / (p_size - 1)) ELSE 0.0 END"))
def grd3(spark, sf):
    return _grid(spark, sf, G.grid_lin("p_size", F.lit(0.0), F.lit(100.0)))


@query("grd3_lin_points_ac", _grid_sql("greatest(p_size, 2)", "p_size + (p_retailprice - p_size) * k / (greatest(p_size, 2) - 1.0)"))
def grd3_ac(spark, sf):
    return _grid(spark, sf, G.grid_lin_ac("p_size", "p_size", "p_retailprice"))


@query(
    "grd4_list",
    "SELECT p_partkey, k, x FROM (SELECT p_partkey, CAST(0 AS INTEGER) AS k, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part)",
)
def grd4(spark, sf):
    values = F.array(F.col("p_size").cast("double"), F.lit(float("nan")), F.col("p_retailprice"))
    return _grid(spark, sf, G.grid_list(values))


@query("grd5_sweep_values", _grid_sql("6", "p_size * pow(p_retailprice / p_size, k / 5.0)", 5))
def grd5(spark, sf):
    return _grid(spark, sf, G.sweep_values("p_size", "p_retailprice", F.lit(6), "log"), 5)


@query("grd6_dc_sweep", _grid_sql("CAST(round(abs((0 - p_size) / -2.6)) AS BIGINT) + 1", "p_size + k * -2.6"))
def grd6(spark, sf):
    return _grid(spark, sf, G.grid_dc("p_size", F.lit(0.0), F.lit(-2.6)))


STEP_KIND = "CASE p_partkey % 7 WHEN 0 THEN 'lin' WHEN 1 THEN 'dec' WHEN 2 THEN 'list' WHEN 3 THEN 'oct' ELSE 'range' END"


@query(
    "grd7_validate_steps",
    f"""WITH s AS (SELECT p_partkey // 2 AS deck, p_partkey AS ord, {STEP_KIND} AS kind, CASE WHEN p_size = 1 THEN 'temp' WHEN p_size = 2 THEN 'R1:R' ELSE 'p' || p_size END AS param,
      p_size - 10 AS start, min(p_partkey) OVER (PARTITION BY p_partkey // 2) AS first FROM part)
    SELECT deck, ord, param, CASE WHEN param LIKE '%:%' THEN 'device parameters cannot be swept' WHEN param = 'temp' THEN 'temperature cannot be swept'
      WHEN kind IN ('dec', 'oct') AND start <= 0 THEN 'start and stop must be positive' WHEN ord > first THEN 'nested steps are not implemented' END AS error FROM s""",
)
def grd7(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 7
    kind = F.when(k == 0, "lin").when(k == 1, "dec").when(k == 2, "list").when(k == 3, "oct").otherwise("range")
    name = F.when(F.col("p_size") == 1, "temp").when(F.col("p_size") == 2, "R1:R").otherwise(F.concat(F.lit("p"), F.col("p_size").cast("string")))
    steps = p.select(
        F.floor(F.col("p_partkey") / 2).alias("deck"), F.col("p_partkey").alias("ord"), name.alias("param"), kind.alias("kind"),
        F.lit(5.0).alias("points"), (F.col("p_size") - 10.0).alias("start"), F.lit(50.0).alias("stop"), F.lit(2.0).alias("step"),
        F.array(F.col("p_retailprice")).alias("list"),
    )
    return K.validate_steps(steps).select("deck", "ord", "param", "error")


@query(
    "join11_nested_cases",
    """SELECT s_suppkey, outer_ix, inner_ix, a, b FROM (SELECT s_suppkey, CAST(i AS BIGINT) AS outer_ix, CAST(s_nationkey + i AS DOUBLE) AS a FROM supplier, (SELECT unnest([0, 1, 2]) AS i)),
       (SELECT CAST(j AS BIGINT) AS inner_ix, j * 0.5 AS b FROM (SELECT unnest([0, 1, 2, 3]) AS j))""",
)
def join11(spark, sf):
    s = table(spark, sf, "supplier")
    outer = G.grid_range("s_nationkey", F.col("s_nationkey") + 2, F.lit(1))
    inner = G.grid_range(F.lit(0), F.lit(1.5), F.lit(0.5))
    return K.nested_cases(outer, inner, ("a", "b"))(s).select("s_suppkey", "outer_ix", "inner_ix", "a", "b")


# ------------------------------------------------------------------ generated waveforms

KINDS = ("DC", "SIN", "PULSE", "EXP", "SFFM", "AM", "PWL")
TSTOP, N = 1.0, 20


def specs(spark, sf):
    p = table(spark, sf, "part")
    a = F.col("p_size").cast("double")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    hole = F.lit(None).cast("double")
    args = (
        F.when(kind == "DC", F.array(a))
        .when(kind == "SIN", F.array(F.lit(1.0), a, F.lit(3.0), F.lit(0.12), F.lit(0.7), F.lit(30.0)))
        .when(kind == "PULSE", F.array(F.lit(-1.0), a, F.lit(0.07), F.lit(0.05), F.lit(0.1), F.lit(0.12), F.lit(0.43)))
        .when(kind == "EXP", F.array(F.lit(0.0), a, F.lit(0.11), F.lit(0.2), F.lit(0.52), hole))
        .when(kind == "SFFM", F.array(F.lit(0.5), a, F.lit(4.0), F.lit(0.3)))
        .when(kind == "AM", F.array(a, F.lit(0.25), F.lit(1.0), F.lit(6.0), F.lit(0.16)))
    )
    knot = lambda t, v: F.struct(F.lit(t).alias("t"), v.alias("v"))
    pwl = F.when(kind == "PWL", F.array(knot(0.1, F.lit(0.0)), knot(0.33, a), knot(0.33, a / 2), knot(0.8, F.lit(1.0))))
    return p.select(F.col("p_partkey").alias("run"), F.lit("s").alias("sig"), kind.alias("kind"), args.alias("p"), pwl.alias("pwl"))


SYNTH = f"""
WITH q AS (SELECT p_partkey AS run, p_partkey % 7 AS k, CAST(p_size AS DOUBLE) AS a, i, {TSTOP} * i / {N} AS t FROM part, (SELECT unnest(range({N} + 1)) AS i)),
r AS (SELECT *, CASE WHEN t - 0.07 >= 0.43 THEN (t - 0.07) - floor((t - 0.07) / 0.43) * 0.43 ELSE t - 0.07 END AS x FROM q)
SELECT run, i, round(CASE k WHEN 0 THEN a
  WHEN 1 THEN CASE WHEN t < 0.12 THEN 1 + a * sin(radians(30)) ELSE 1 + a * exp(-(t - 0.12) * 0.7) * sin(2 * pi() * 3 * (t - 0.12) + radians(30)) END
  WHEN 2 THEN CASE WHEN t < 0.07 THEN -1 WHEN x < 0.05 THEN -1 + (a + 1) * x / 0.05 WHEN x < 0.05 + 0.12 THEN a
              WHEN x < 0.05 + 0.12 + 0.1 THEN a + (-1 - a) * (x - 0.05 - 0.12) / 0.1 ELSE -1 END
  WHEN 3 THEN CASE WHEN t > 0.11 THEN a * (1 - exp(-(t - 0.11) / 0.2)) ELSE 0 END + CASE WHEN t > 0.52 THEN -a * (1 - exp(-(t - 0.52) / {TSTOP / N})) ELSE 0 END
  WHEN 4 THEN 0.5 + a * sin(2 * pi() * 4 * t + 0.3 * sin(2 * pi() * {1 / TSTOP} * t))
  WHEN 5 THEN CASE WHEN t < 0.16 THEN 0 ELSE a * (0.25 + sin(2 * pi() * (t - 0.16))) * sin(2 * pi() * 6 * (t - 0.16)) END
  ELSE CASE WHEN t <= 0.1 THEN 0 WHEN t <= 0.33 THEN a * (t - 0.1) / (0.33 - 0.1) WHEN t <= 0.8 THEN a / 2 + (1 - a / 2) * (t - 0.33) / (0.8 - 0.33) ELSE 1 END
  END, 6) + 0.0 AS v FROM r
"""


@query("src9_synth_waves", SYNTH)
def src9(spark, sf):
    return synth.synth_waves(specs(spark, sf), TSTOP, N).select("run", "i", rounded("v"))


@query(
    "src10_breakpoints",
    """WITH q AS (SELECT p_partkey AS run, p_partkey % 7 AS k FROM part),
    b AS (SELECT run, 0.12 AS t FROM q WHERE k = 1
      UNION ALL SELECT run, 0.07 + j * 0.43 + e FROM q, (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([0, 0.05, 0.17, 0.27]) AS e) WHERE k = 2
      UNION ALL SELECT run, unnest([0.11, 0.52]) FROM q WHERE k = 3
      UNION ALL SELECT run, unnest([0.1, 0.33, 0.33, 0.8]) FROM q WHERE k = 6)
    SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS INTEGER) AS k, CAST(round(t, 6) AS DOUBLE) AS t FROM b WHERE t >= 0 AND t <= 1.0""",
)
def src10(spark, sf):
    return synth.breakpoints(specs(spark, sf), TSTOP).select("run", "k", rounded("t"))
