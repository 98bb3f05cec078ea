"""SQL functions give what the column functions give, on edge values too, and leave no call in the plan."""

import math

from pyspark.sql import functions as F

from sparkwave.functions import names as N
from sparkwave.functions import scalar as X
from sparkwave.functions import sql as Q


def test_twins(spark):
    Q.register(spark)
    values = [0.0, -0.0, 1.0, -1.0, 0.4, -2.5, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x, y) for x in values for y in (0.0, 2.0, -3.0, None)], "x double, y double")
    one = "abs sqrt exp ln log10 sin cos tan asin acos atan sinh cosh tanh floor ceil int sgn uramp u not".split()
    two = "pow pwr pwrs min max and or mod div hypot".split()
    same = [F.expr(f"wave_{f}(x)").eqNullSafe(getattr(X, f"fn_{f}")(F.col("x"))).alias(f) for f in one]
    same += [F.expr(f"wave_{f}(x, y)").eqNullSafe(getattr(X, f"fn_{f}")(F.col("x"), F.col("y"))).alias(f) for f in two]
    same.append(F.expr("wave_limit(x, y, 1)").eqNullSafe(X.fn_limit("x", F.col("y"), F.lit(1.0))).alias("limit"))
    same.append(F.expr("wave_if(x, y, 1)").eqNullSafe(X.fn_if("x", F.col("y"), F.lit(1.0))).alias("if"))
    same.append(F.expr("wave_decibels(x, y)").eqNullSafe(X.decibels("x", "y")).alias("decibels"))
    same.append(F.expr("wave_phase_degrees(x, y)").eqNullSafe(X.phase_degrees("x", "y")).alias("phase"))
    usual = df.where("NOT isnan(x) AND abs(x) < 1e18 OR x IS NULL")
    for rows in (usual.select(*same).collect(), df.select(*[c for c, f in zip(same, one + two) if f not in ("floor", "ceil", "int")]).collect()):
        assert [{k: v for k, v in r.asDict().items() if not v} for r in rows] == [{}] * len(rows)


def test_texts(spark):
    Q.register(spark)
    df = spark.createDataFrame([(t,) for t in ("470u", " 2meg ", "1mil", "-.5k", "x1", "", None, "V( out )", "i(r1)", " plain ", "GND", "0")], "t string")
    pairs = [("eng_parse", X.eng_parse), ("normalize_signal", X.normalize_signal), ("is_ground", N.is_ground)]
    for r in df.select(*[F.expr(f"wave_{name}(t)").eqNullSafe(fn("t")).alias(name) for name, fn in pairs]).collect():
        assert all(r)
    assert math.isclose(spark.sql("SELECT wave_eng_parse('470uF')").first()[0], 470e-6)


def test_bodies_are_part_of_the_plan(spark):
    Q.register(spark)
    plan = spark.range(3).selectExpr("wave_pwrs(id, 2) AS z")._jdf.queryExecution().executedPlan().toString()
    assert "wave_" not in plan and "pow(abs(" in plan.lower()
