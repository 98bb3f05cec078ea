"""Work that must be done once per row, and plans that must not repeat themselves."""

import pytest
from pyspark.sql import functions as F

from sparkwave.operators import hierarchy as H
from sparkwave.operators import lines as L
from sparkwave.operators import measure as M
from sparkwave.operators import triage as T
from sparkwave.plans import chunks as C
from sparkwave.suite.registry import spread


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_card_is_taken_apart_once(spark):
    texts = ["a=1 b = {2*x} A=3 c=(d=4", "no pairs", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.card_params("t").alias("p"))
    assert optimized(got).count("regexp_extract_all") == 1
    assert {r.t: r.p for r in got.collect()} == {
        texts[0]: {"a": "3", "b": "{2*x}", "c": "d=4"}, "no pairs": {}, "": {}, None: None,
    }


def test_rows_of_one_file_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    got = spread(spark.read.parquet(f"{tmp_path}/t"))
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert got.count() == 1000 and got.distinct().count() == 1000


def test_a_parameter_is_read_once_a_pass(spark):
    rows = [
        (1, {"top": "{mid}", "mid": "R", "r": "2k", "hard": "{r*2}"}, {"top": "{price}"}, {"price": 7.5}),
        (2, {"top": "{mid}", "mid": "R", "r": "2k"}, {}, {"price": 7.5}),
        (3, {}, {"x": "1meg", "y": "none"}, {}),
        (4, None, None, None),
    ]
    kind = "id int, defaults map<string,string>, overrides map<string,string>, caller map<string,double>"
    got = H.inherit_params(spark.createDataFrame(rows, kind), ["id"])
    # once among the defaults and once among the overrides, the mantissa and the rest of each
    assert optimized(got).count("regexp_extract(") == 4
    found = {r.id: (r.params, r.leftovers) for r in got.collect()}
    assert found[1] == ({"price": 7.5, "r": 2000.0, "mid": 2000.0, "top": 7.5}, ["hard"])
    assert found[2] == ({"price": 7.5, "r": 2000.0, "mid": 2000.0, "top": 2000.0}, [])
    assert found[3] == ({"x": 1e6}, ["y"])
    assert found[4] == (None, None)


@pytest.mark.parametrize("ring", [False, True])
def test_includes_are_read_once(spark, ring):
    read = spark.sparkContext.accumulator(0)

    def seen(path):
        read.add(1)
        return path

    rows = [(f"f{n}", f"f{n + 1}", 1) for n in range(5)] + ([("f5", "f3", 2)] if ring else [])
    edges = spark.createDataFrame(rows, "path string, target string, line int")
    edges = edges.withColumn("path", F.udf(seen).asNondeterministic()("path"))
    reached, errors = H.include_graph(edges, spark.createDataFrame([("f0",)], "path string"))
    assert {(r.path, r.depth) for r in reached.collect()} == {(f"f{n}", n) for n in range(6)}
    assert {r.path for r in errors.collect()} == ({"f3", "f4", "f5"} if ring else set())
    assert read.value == len(rows)


def test_decks_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    bodies = {
        "a": ("t\nR1 a b 1\n.end", "yes"), "b": ("t\n.subckt s a b\nR1 a b 1\n.ends\nX1 p q s", "yes"),
        "c": ("t\nD1 a b NOPE", "invalid"), "d": (" \n* note", "yes"), "e": ("t\n.subckt s a b\n+ c=1", "invalid"),
    }
    decks = spark.createDataFrame([(d, text) for d, (text, _) in bodies.items()], "deck string, text string")
    got = T.triage(decks.withColumn("text", F.udf(seen).asNondeterministic()("text")))
    assert {r.deck: r.kind for r in got.collect()} == {d: kind for d, (_, kind) in bodies.items()}
    assert read.value == len(bodies)


@pytest.mark.parametrize("literal", [100_000, 3])
def test_cuts_do_not_grow_into_the_plan(spark, monkeypatch, literal):
    """Clumps need cuts of cuts; long lists of pieces are read from written tables, whatever led to them."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", literal)
    rows = [(k, "a", n, float(n % 7) + (n % 60) * 1e-5 * (n % 7 == 3) + k, float(n)) for k in range(4) for n in range(600)]
    rows += [(9, "a", n, 2.0, float(n)) for n in range(100)] + [(None, "a", 1, 1.0, 1.0)]
    waves = spark.createDataFrame(rows, "run long, sig string, i long, t double, v double")
    split = C.plan_chunks(waves, ["run", "sig"], "t", "i", 40)
    assert len(split.levels) > 1
    for level, _ in split.levels:
        assert "Aggregate" not in optimized(level) and "Join" not in optimized(level)
    sizes = split.assign(waves, "t", "i").groupBy("run", C.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 40
    points = waves.select("run", "sig", F.col("i").alias("pid"), (F.col("t") + 0.3).alias("x")).where("run is not null")
    whole, cut = (M.value_at(waves, points, rows_per_chunk=n).select("run", "pid", F.round("v", 6).alias("v")) for n in (None, 40))
    # a frame from each row to the end of its key is quadratic in the pieces
    assert ", 1, unboundedfollowing" not in optimized(cut).lower()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_even_rows_are_cut_once(spark):
    waves = spark.range(200_000).select(F.lit(1).alias("run"), F.lit("a").alias("sig"), F.col("id").alias("i"), F.col("id").cast("double").alias("t"))
    assert len(C.plan_chunks(waves, ["run", "sig"], "t", "i", 50).levels) == 1
