"""Points, measurements and probes that come as tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwave.operators import measure as M, probes as P

POINT = "run long, sig string, id int, x double"


def waves(spark, seed=3):
    """Ties, one-sample keys and gaps."""
    draw = random.Random(seed)
    rows = []
    for run in range(3):
        for sig, n in (("a", 200), ("B", 7), ("one", 1), ("flat", 3)):
            t = sorted(draw.randrange(0, 60) if sig != "flat" else 5 for _ in range(n))
            rows += [(run, sig, i, float(x), draw.random()) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, "run long, sig string, i long, t double, v double").repartition(5)


def points(spark, count=90, seed=4):
    draw = random.Random(seed)
    xs = [draw.choice([-3.0, 0.0, 5.0, 59.0, 70.0, draw.uniform(0, 60), float(draw.randrange(60))]) for _ in range(count)]
    rows = [(draw.randrange(4), draw.choice(["a", "B", "one", "flat", "none"]), k, x) for k, x in enumerate(xs)]
    return spark.createDataFrame([*rows, (0, "a", -1, None)], POINT)


def bag(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_few_points_equal_the_plain_form(spark):
    w, p = waves(spark).cache(), points(spark)
    assert bag(M.value_at_few(w, p)) == bag(M.value_at(w, p))
    assert bag(M.nearest_few(w, p)) == bag(M.nearest(w, p))
    none = p.limit(0)
    assert M.value_at_few(w, none).count() == 0
    # a point of a wave without samples keeps its row
    assert bag(M.nearest_few(w.limit(0), p)) == bag(M.nearest(w.limit(0), p)) and M.nearest(w.limit(0), p).count() == 91


def test_few_points_move_few_samples(spark, tmp_path):
    """Every exchange of the samples lies above the rows that each task keeps."""
    waves(spark).write.parquet(str(tmp_path / "w"))
    w = spark.read.parquet(str(tmp_path / "w"))
    near = M._around(w, points(spark), ["run", "sig"], "x", 2, "last")
    plan = near._jdf.queryExecution().executedPlan().toString()
    below = plan.split("FileScan parquet")[0].rsplit("Exchange hashpartitioning", 1)[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_many_points_take_the_plain_form(spark, monkeypatch):
    w, p = waves(spark), points(spark)
    expected = bag(M.value_at_few(w, p))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 5)
    assert bag(M.value_at_few(w, p)) == expected


SPECS = [
    M.Spec("m", "max", "A"), M.Spec("w", "when", "a", level=0.5, nth=2), M.Spec("p", "when", "a", other="b"),
    M.Spec("f", "find", "a", at=7.0), M.Spec("g", "find", "a", other="b", level=0.4), M.Spec("d", "trig", "a", level=0.5, other="b", level2=0.5),
    M.Spec("lost", "avg", "zz"), M.Spec("odd", "mode", "a"), M.Spec("half", "trig", "a", level=0.5, other="qq", level2=1.0),
]


def test_table_of_measurements_equals_the_list(spark):
    w = waves(spark).cache()
    inner = ", ".join(f"{n} {t}" for n, t in M.SPEC_TYPES.items())
    table = spark.createDataFrame([M._typed(s) for s in SPECS], inner)
    assert bag(M.measure(w, table)) == bag(M.measure(w, SPECS))
    bare = table.where("name in ('m', 'lost')").select("name", "func", "sig")
    assert bag(M.measure(w, bare)) == bag(M.measure(w, [SPECS[0], SPECS[6]]))
    assert M.measure(w, table.limit(0)).count() == M.measure(w, []).count() == 0
    with pytest.raises(ValueError):
        M.measure(w, table.withColumn("nth", F.lit(0).cast("long")))
    assert bag(M.capture(w, table)) == bag(M.capture(w, SPECS))


def test_table_of_probes_equals_the_list(spark):
    asked = [
        P.Probe("v", "voltage", "A"), P.Probe("d", "differential", "a", "b"), P.Probe("g", "differential", "a", "0"),
        P.Probe("z", "voltage", "gnd"), P.Probe("c", "current", "L1"), P.Probe("n", "voltage", None), P.Probe("l", "voltage", "nope", label="mine"),
    ]
    table = spark.createDataFrame([(p.id, p.kind, p.target, p.target2, p.label) for p in asked], "id string, kind string, target string, target2 string, label string")
    w = waves(spark).where("sig in ('a', 'B')").cache()
    assert bag(P.resolve_probes(w, table)) == bag(P.resolve_probes(w, asked))
    assert bag(P.probe_status(w, table)) == bag(P.probe_status(w, asked))
    assert {r.id for r in P.resolve_probes(w, table).select("id").distinct().collect()} == {"v", "d", "g", "z"}
    assert P.resolve_probes(w, table.limit(0)).count() == P.probe_status(w, []).count() == 0
    status = {r.id: r.reason for r in P.probe_status(w, table).where("run = 0").collect()}
    assert status["c"] == "no branch current: L1" and status["l"] == "no such net: nope" and status["z"] is None
