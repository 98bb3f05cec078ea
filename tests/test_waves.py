"""Closed forms on unevenly sampled waves, and the same answers with every key split."""

import math

import pytest

from sparkwave.operators import cases, compare, measure as M, samples as S, spectral as P
from sparkwave.sources.waves import waves_from_wide

WIDE = "run long, i long, t double, a double, b double"


@pytest.fixture(scope="module")
def ramp(spark):
    rows = [(1, i, (i / 500) ** 2, (i / 500) ** 2, max(0.0, (i / 500) ** 2 - 0.25)) for i in range(501)]
    return waves_from_wide(spark.createDataFrame(rows, WIDE), "t", ["a", "b"]).cache()


def one(df):
    return {r["name"]: (r["value"], r["error"]) for r in df.collect()}


@pytest.mark.parametrize("rows", [None, 60])
def test_ramp(ramp, rows):
    got = one(M.measure(ramp, [
        M.Spec("avg", "avg", "a"), M.Spec("rms", "rms", "A"), M.Spec("win", "avg", "a", t_from=0.3, t_to=0.7),
        M.Spec("when", "when", "a", level=0.55), M.Spec("never", "when", "a", level=99.0),
        M.Spec("delay", "trig", "a", level=0.5, other="b", level2=0.5), M.Spec("lost", "avg", "zz"),
        M.Spec("find", "find", "b", other="a", level=0.5), M.Spec("empty", "avg", "a", t_from=5.0, t_to=6.0),
    ], rows))
    assert got["avg"][0] == pytest.approx(0.5, abs=1e-9)
    assert got["rms"][0] == pytest.approx(1 / math.sqrt(3), abs=1e-4)
    assert got["win"][0] == pytest.approx(0.5, abs=1e-9)
    assert got["when"][0] == pytest.approx(0.55, abs=1e-12)
    assert got["delay"][0] == pytest.approx(0.25, abs=1e-9)
    assert got["find"][0] == pytest.approx(0.25, abs=1e-9)
    assert got["never"] == (None, M.NO_WHEN)
    assert got["empty"] == (None, M.NO_WINDOW)
    assert got["lost"][0] is None and "zz" in got["lost"][1]


def wave(spark, points):
    return spark.createDataFrame([(1, "s", i, float(t), float(v)) for i, (t, v) in enumerate(points)], "run long, sig string, i long, t double, v double")


def test_triangle_touch_and_repeated_instants(spark):
    tri = wave(spark, [(0, 0), (1, 1), (2, 0), (3, 1)])
    x = lambda e, n: S.nth_crossing(tri, 0.5, n, e).first()["x"]
    assert (x("rise", 1), x("fall", 1), x("rise", 2)) == (0.5, 1.5, 2.5)
    assert S.crossings(wave(spark, [(0, 0), (1, 1), (2, 0)]), 1.0).count() == 1
    # of two samples at the window start only the later counts, at its end only the earlier
    jump = wave(spark, [(0, 5), (0, 1), (1, 2), (1, 9)])
    got = one(M.measure(jump, [M.Spec("hi", "max", "s"), M.Spec("lo", "min", "s")]))
    assert (got["hi"][0], got["lo"][0]) == (2.0, 1.0)


def test_value_at_extrapolates_and_nearest_takes_first(spark):
    w = wave(spark, [(0, 0), (1, 2), (3, 0)])
    pts = spark.createDataFrame([(1, "s", x) for x in (-1.0, 0.0, 0.5, 2.0, 4.0)], "run long, sig string, x double")
    for rows in (None, 2):
        got = {r.x: (r.v, r.extrapolated) for r in M.value_at(w, pts, rows_per_chunk=rows).collect()}
        assert got == {-1.0: (-2.0, True), 0.0: (0.0, False), 0.5: (1.0, False), 2.0: (1.0, False), 4.0: (-1.0, True)}
        near = {r.x: r.v for r in M.nearest(w, pts, rows_per_chunk=rows).collect()}
        assert near == {-1.0: 0.0, 0.0: 0.0, 0.5: 0.0, 2.0: 2.0, 4.0: 0.0}


def test_hot_key_equals_brute_force(spark):
    """One key holds most rows, most of them in one narrow stretch and at one instant."""
    import random

    rnd = random.Random(5)
    hot = sorted([rnd.random() * 1e-3 for _ in range(3000)] + [0.0005] * 400 + [rnd.random() * 100 for _ in range(300)])
    rows = [(1, "s", i, t, rnd.uniform(-1, 1)) for i, t in enumerate(hot)] + [(2, "s", i, float(i), float(i)) for i in range(50)]
    w = spark.createDataFrame(rows, "run long, sig string, i long, t double, v double").repartition(5)
    got = sorted((r.run, r.i, r.t1, r.v1) for r in S.segments(w, rows_per_chunk=200).collect())
    want = sorted((a[0], a[2], b[3], b[4]) for a, b in zip(rows, rows[1:]) if a[0] == b[0])
    assert got == want
    d = [(r.run, r.slot, r.i) for r in S.decimate(w, 100, rows_per_chunk=200).collect()]
    assert sorted(d) == sorted((r.run, r.slot, r.i) for r in S.decimate(w, 100).collect())


def test_square_wave_distortion(spark):
    from sparkwave.sources.synth import synth_waves

    spec = spark.createDataFrame([(1, "q", "PULSE", [-1.0, 1.0, 0.0, 1e-9, 1e-9, 0.5e-3, 1e-3], None)],
                                 "run long, sig string, kind string, p array<double>, pwl array<struct<t:double,v:double>>")
    h = P.fourier(synth_waves(spec, 3e-3, 3000), 1000.0)
    mags = {r.n: r.norm for r in h.collect()}
    assert [mags[k] for k in (3, 5, 7)] == [pytest.approx(1 / k, abs=2e-3) for k in (3, 5, 7)]
    want = 100 * math.sqrt(1 / 9 + 1 / 25 + 1 / 49 + 1 / 81)
    assert P.thd(h).first()["thd"] == pytest.approx(want, abs=0.05)
    assert P.resample_errors(wave(spark, [(0, 0), (1, 1)]), 0.5).count() == 1


def test_run_equals_itself(ramp):
    worst = compare.worst_error(compare.diff_runs(ramp, ramp)).collect()
    assert all(r.failed == 0 and r.worst == 0.0 for r in worst)


def test_summary_of_failed_and_missing(spark):
    rows = [(True, float(x)) for x in range(4)] + [(False, 9.0), (True, float("nan")), (True, float("inf"))]
    r = spark.createDataFrame(rows, "ok boolean, value double").selectExpr("'m' AS name", "ok", "value")
    for size in (None, 1):
        got = {x["name"]: x for x in cases.summarize(r, ["m", "none"], rows_per_chunk=size).collect()}
        assert (got["m"]["n"], got["m"]["p50"], got["m"]["mean"]) == (4, 2.0, 1.5)
        assert got["none"]["n"] is None


def test_failing_case_is_a_row(spark):
    c = cases.sample_sets(spark, [("r", 1.0, 0.1, "uniform")], 4, 7)

    def response(p):
        if p["r"] > 1:
            raise ValueError("too large")
        return {"y": 2 * p["r"]}

    got = cases.evaluate_cases_with(c, response).collect()
    assert len(got) == 4 and all((r.error is None) == r.ok for r in got)


def test_draws_do_not_depend_on_partitions(spark):
    def reference(seed, n):
        out, a = [], seed & 0xFFFFFFFF
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    from pyspark.sql import functions as F
    from sparkwave.functions.draws import uniform

    for parts in (1, 7):
        df = spark.range(0, 500, 1, parts).select("id", uniform(F.lit(42), "id").alias("u"))
        assert [r.u for r in df.orderBy("id").collect()] == reference(42, 500)


def test_missing_samples_are_errors(spark):
    rows = [(1, "s", i, float(i), None if i == 4 else 10.0) for i in range(11)]
    w = spark.createDataFrame(rows, "run long, sig string, i long, t double, v double")
    specs = [M.Spec(f, f, "s") for f in ("avg", "integ", "rms", "max")] + [M.Spec("late", "avg", "s", t_from=6.0, t_to=9.0)]
    got = {r.name: (r.value, r.error) for r in M.measure(w, specs).collect()}
    assert {got[f] for f in ("avg", "integ", "rms")} == {(None, M.MISSING)}
    assert got["max"] == (10.0, None) and got["late"] == (10.0, None)


def test_missing_samples_fail_a_comparison(spark):
    rows = [(1, "s", i, float(i), 10.0) for i in range(5)]
    schema = "run long, sig string, i long, t double, v double"
    whole = spark.createDataFrame(rows, schema)
    gap = spark.createDataFrame([(*r[:4], None if r[2] == 2 else r[4]) for r in rows], schema)
    for ours, reference in ((gap, whole), (whole, gap)):
        worst = compare.worst_error(compare.diff_runs(ours, reference)).first()
        assert (worst.n, worst.failed, worst.worst) == (5, 1, float("inf"))
    assert compare.worst_error(compare.diff_runs(whole, whole)).first().failed == 0


def test_thousands_of_measurements(spark):
    w = spark.createDataFrame([(1, "s", i, float(i), float(i)) for i in range(11)], "run long, sig string, i long, t double, v double")
    specs = spark.range(5000).selectExpr("concat('m', id) AS name", "'avg' AS func", "'s' AS sig", "0.0D AS t_from", "(1 + id % 10) * 1.0D AS t_to")
    got = M.measure(w, specs).collect()
    assert len(got) == 5000 and all(abs(r.value - (1 + int(r.name[1:]) % 10) / 2) < 1e-9 for r in got)


def test_sweep_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    df = cases.sweep_cases(spark, "r", 1.0, 5.0, 10_000_000)
    assert df.rdd.getNumPartitions() > 1
    last = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("params")["r"]).alias("top"), F.min(F.col("params")["r"]).alias("low")).first()
    assert (last.n, last.top, last.low) == (10_000_000, 5.0, 1.0)
