"""Waves that arrive as files: lossless reading, running ranges, online measures.

Ranges and progress are native streaming aggregates. Crossings, integrals and
order checks need the sample before each sample, so they run per micro-batch with
the batch operators: the last sample of every key is kept in a small table next
to the output and joins the next batch as its first row. A key that fills a whole
micro-batch is therefore still split over tasks. Batch ``n`` writes the folder
``batch=n``, so a repeated batch replaces itself. Batch ``n`` needs the state of
batch ``n - 1`` only, and older states are removed when it is done, so that state
and its reading do not grow with the number of batches. The state also counts what
every key accepted and rejected, which makes up the rows of the runs' status.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwave.operators import measure as M
from sparkwave.operators import samples as S
from sparkwave.plans import chunks as C
from sparkwave.plans.lineage import remove, written_numbers

WAVES = "run long, sig string, i long, t double, v double"
LAST = "run long, sig string, t_first double, t double, i long, v double, accepted long, rejected long"


def read_wave_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New Parquet files below ``path``; ``max_files`` per micro-batch holds back a fast producer."""
    reader = spark.readStream.schema(WAVES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(writer, timeout: int | None = None) -> StreamingQuery:
    """Drain everything that is there, then finish."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    return query


def status(query: StreamingQuery) -> str:
    """RUNNING, DONE or ERROR."""
    if query.exception() is not None:
        return "ERROR"
    return "RUNNING" if query.isActive else "DONE"


def stream_range(stream: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Running range of the finite values; it only ever widens."""
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    return stream.groupBy(*keys).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(F.lit(1)).alias("n"))


def stream_progress(stream: DataFrame) -> DataFrame:
    """How far each run has come."""
    return stream.groupBy("run").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("accepted"))


def stream_capture(stream: DataFrame, specs) -> DataFrame:
    """Only the signals that some measurement names."""
    return M.capture(stream, specs)


def _last_state(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The newest last-sample table older than ``batch``."""
    if batch == 0:
        return spark.createDataFrame([], LAST)
    return spark.read.schema(LAST).parquet(f"{folder}/last/batch={batch - 1}")


def _step(out: str, measure: Callable[[DataFrame, DataFrame], DataFrame], rows_per_chunk: int | None):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("run", "sig", "i", "t", "v").persist()
        last = _last_state(spark, out, number)
        seen = last.select("run", "sig", F.struct("t", "i").alias("_last"))
        placed = batch.select("run", "sig", "i", "t", "v").join(seen, ["run", "sig"], "left")
        late = placed.where(F.col("_last").isNotNull() & (F.struct("t", "i") <= F.col("_last")))
        fresh = placed.where(F.col("_last").isNull() | (F.struct("t", "i") > F.col("_last"))).drop("_last")
        # the carried sample is the first row of the batch for its key
        rows = fresh.unionByName(last.select("run", "sig", "i", "t", "v"))
        measure(rows, last).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        late.select("run", "sig", "i", "t", F.lit("older than the stream").alias("reason")).write.mode("overwrite").parquet(
            f"{out}/late/batch={number}"
        )
        # what was carried over was counted before
        now = rows.groupBy("run", "sig").agg(F.min("t").alias("_t0"), F.max(F.struct("t", "i", "v")).alias("_s"), F.count(F.lit(1)).alias("_rows"))
        old = last.select("run", "sig", F.col("t_first").alias("_old"), "accepted", "rejected")
        behind = late.groupBy("run", "sig").agg(F.count(F.lit(1)).alias("_late"))
        kept = now.join(old, ["run", "sig"], "left").join(behind, ["run", "sig"], "left").select(
            "run", "sig", F.coalesce("_old", "_t0").alias("t_first"), "_s.t", "_s.i", "_s.v",
            F.coalesce(F.col("accepted") + F.col("_rows") - 1, "_rows").alias("accepted"),
            (F.coalesce("rejected", F.lit(0)) + F.coalesce("_late", F.lit(0))).cast("long").alias("rejected"),
        )
        kept.write.mode("overwrite").parquet(f"{out}/last/batch={number}")
        batch.unpersist()
        for done in written_numbers(spark, f"{out}/last"):
            if done < number - 1:
                remove(spark, f"{out}/last/batch={done}")

    return run


def _writer(stream: DataFrame, out: str, measure, rows_per_chunk):
    return stream.writeStream.foreachBatch(_step(out, measure, rows_per_chunk)).option("checkpointLocation", f"{out}/checkpoint")


def stream_crossings(stream: DataFrame, out: str, level: float, edge: str = "cross", rows_per_chunk: int | None = None):
    """A writer that adds the crossings of each micro-batch to ``out``."""

    def measure(rows: DataFrame, last: DataFrame) -> DataFrame:
        pairs, _ = S.samples(rows, rows_per_chunk=rows_per_chunk)
        start = last.select("run", "sig", "t_first")
        x = S.crossing_at(F.lit(float(level)), F.lit(edge))
        found = pairs.join(start, ["run", "sig"], "left")
        began = F.coalesce("t_first", "x_first")
        return (
            found.where(F.col("x_next") > began)
            .select("run", "sig", "i", F.col("t").alias("t_left"), x.alias("x"))
            .where(F.col("x").isNotNull())
        )

    return _writer(stream, out, measure, rows_per_chunk)


def stream_integ(stream: DataFrame, out: str, rows_per_chunk: int | None = None):
    """A writer that adds the area under each key, one row per key and micro-batch; NULL where samples are missing."""

    def measure(rows: DataFrame, last: DataFrame) -> DataFrame:
        pairs, _ = S.samples(rows, rows_per_chunk=rows_per_chunk)
        part = (F.col("v") + F.col("v_next")) / 2 * (F.col("x_next") - F.col("t"))
        gaps = F.count_if(F.col("x_next").isNotNull() & part.isNull())
        return pairs.groupBy("run", "sig").agg(F.when(gaps == 0, F.coalesce(F.sum(part), F.lit(0.0))).alias("area"))

    return _writer(stream, out, measure, rows_per_chunk)


def stream_monotonic(stream: DataFrame, out: str, rows_per_chunk: int | None = None):
    """A writer that adds every sample whose time is before that of its predecessor by ordinal."""

    def measure(rows: DataFrame, last: DataFrame) -> DataFrame:
        by_ordinal = rows.select("run", "sig", F.col("i").cast("double").alias("n"), "i", "t")
        split = C.plan_chunks(by_ordinal, S.KEYS, "n", "i", rows_per_chunk)
        pairs = C.neighbours(by_ordinal, S.KEYS, "n", "i", "t", split)
        return pairs.where(F.col("v_next") < F.col("t")).select(
            "run", "sig", F.col("x_next").cast("long").alias("i"), F.col("v_next").alias("t"), F.lit("time goes back").alias("reason")
        )

    return _writer(stream, out, measure, rows_per_chunk)


def _newest(spark: SparkSession, out: str) -> DataFrame:
    """The state after the last batch that was done; no other one is read."""
    done = written_numbers(spark, f"{out}/last")
    return _last_state(spark, out, done[-1] + 1 if done else 0)


def read_runs(spark: SparkSession, out: str, query: StreamingQuery) -> DataFrame:
    """One row per run: how far it has come, the samples it accepted and rejected (older than the stream), and the query's status."""
    counts = [F.sum(c).alias(c) for c in ("accepted", "rejected")]
    return _newest(spark, out).groupBy("run").agg(F.max("t").alias("t"), *counts).withColumn("status", F.lit(status(query)))


def read_crossings(spark: SparkSession, out: str) -> DataFrame:
    """All crossings so far; a jump at the very last instant is not one yet."""
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")
    last = _newest(spark, out).select("run", "sig", F.col("t").alias("_end"))
    return rows.join(last, ["run", "sig"]).where(F.col("t_left") < F.col("_end")).select("run", "sig", "i", "x")


def read_integral(spark: SparkSession, out: str) -> DataFrame:
    """Area and time average of every key so far."""
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    total = rows.groupBy("run", "sig").agg(F.when(F.count("area") == F.count(F.lit(1)), F.sum("area")).alias("area"))
    span = _newest(spark, out).select("run", "sig", (F.col("t") - F.col("t_first")).alias("_span"))
    return total.join(span, ["run", "sig"]).select("run", "sig", "area", F.try_divide("area", F.col("_span")).alias("avg"))


def read_violations(spark: SparkSession, out: str) -> DataFrame:
    """Samples out of order, and samples that came after the stream had passed them."""
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")
    return rows.unionByName(spark.read.option("basePath", f"{out}/late").parquet(f"{out}/late").drop("batch"))
