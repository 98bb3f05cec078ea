"""Streams give what the batch gives, with discontinuities on batch borders and late files."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparkwave.operators import samples as S
from sparkwave.plans.lineage import written_numbers
from sparkwave.streaming import waves as W


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "s", i, float(i // 2), float((i * 7) % 11 - 5)) for i in range(60)]
    w = spark.createDataFrame(rows, W.WAVES)
    for n, (a, b) in enumerate(((0, 21), (21, 40), (40, 60))):
        w.where(f"i >= {a} AND i < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = W.run_available(W.stream_crossings(W.read_wave_stream(spark, str(tmp_path / "in"), 1), out, 0.5))
    assert W.status(q) == "DONE"
    got = sorted((r.i, r.x) for r in W.read_crossings(spark, out).collect())
    assert got == sorted((r.i, r.x) for r in S.crossings(w, 0.5).collect())
    # a file behind the stream is reported
    spark.createDataFrame([(1, "s", 3, 1.0, 0.0)], W.WAVES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    W.run_available(W.stream_crossings(W.read_wave_stream(spark, str(tmp_path / "in"), 1), out, 0.5))
    late = spark.read.parquet(f"{out}/late").collect()
    assert [(r.i, r.t) for r in late] == [(3, 1.0)]
    assert len(W.read_crossings(spark, out).collect()) == len(got)


def test_state_does_not_grow(spark, tmp_path):
    """Many batches leave two states, and the runs' status counts what was accepted and rejected, also after a failure."""
    rows = [(k % 2, "s", k, float(k), float(k % 5)) for k in range(48)]
    for n in range(12):
        # every fourth file brings a sample from before
        late = [(0, "s", 0, 0.0, 1.0)] if n and n % 4 == 0 else []
        spark.createDataFrame(rows[4 * n : 4 * n + 4] + late, W.WAVES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = W.run_available(W.stream_integ(W.read_wave_stream(spark, str(tmp_path / "in"), 1), out))
    assert written_numbers(spark, f"{out}/last") == [10, 11]
    runs = {r.run: (r.t, r.accepted, r.rejected, r.status) for r in W.read_runs(spark, out, q).collect()}
    assert runs == {0: (46.0, 24, 2, "DONE"), 1: (47.0, 24, 0, "DONE")}

    spark.createDataFrame([(0, "s", 99, 99.0, 1.0)], W.WAVES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    writer = W._writer(W.read_wave_stream(spark, str(tmp_path / "in"), 1), out, lambda rows, last: rows.select(F.raise_error(F.lit("no disk"))), None)
    failing = writer.trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        failing.awaitTermination()
    runs = {r.run: (r.t, r.accepted, r.rejected, r.status) for r in W.read_runs(spark, out, failing).collect()}
    assert runs == {0: (46.0, 24, 2, "ERROR"), 1: (47.0, 24, 0, "ERROR")}


def test_draws_end(spark):
    from sparkwave.functions.draws import uniform

    last = spark.range(1).select(uniform(F.lit(1), F.lit(2**32 - 1)).alias("u"), uniform(F.lit(1), F.col("id")).alias("first")).first()
    assert 0 <= last.u < 1 and 0 <= last.first < 1
    with pytest.raises(Exception, match="a draw must be"):
        spark.range(1).select(uniform(F.lit(1), F.col("id") + 2**32)).collect()
