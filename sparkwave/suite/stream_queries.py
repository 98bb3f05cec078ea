"""The events table read as a stream, drained, and compared with the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwave.operators import measure as M
from sparkwave.plans.lineage import shared_folder
from sparkwave.sources.waves import waves_from_events
from sparkwave.streaming import waves as W
from sparkwave.suite.registry import query, rounded, table
from sparkwave.suite.wave_queries import LEVEL, PRE


def stream(spark, sf):
    e = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return waves_from_events(e, "ts", "event_type", "value", F.col("user_id") % 8, "event_id")


def arriving(spark, sf, change=None):
    """The events as files that arrive in order of their ids, one micro-batch each: four, or one per million events if these are more.

    Events without an id arrive first.
    """
    e = table(spark, sf, "events")
    bounds = e.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    low, high, n = bounds
    if change is not None:
        e = change(e)
    parts = max(4, -(-n // 1_000_000))
    w = waves_from_events(e, "ts", "event_type", "value", F.col("user_id") % 8, "event_id").select("run", "sig", "i", "t", "v")
    folder = shared_folder(spark, "arriving")
    for k in range(parts):
        a, b = low + (high + 1 - low) * k // parts, low + (high + 1 - low) * (k + 1) // parts
        here = (F.col("i") >= a) & (F.col("i") < b)
        w.where(here if k else here | F.col("i").isNull()).select(*[F.col(c).cast(t) for c, t in (("run", "long"), ("sig", "string"), ("i", "long"), ("t", "double"), ("v", "double"))]).coalesce(1).write.mode("append").parquet(folder)
    return W.read_wave_stream(spark, folder, 1)


def _table(spark, df, mode):
    """The newest state of an aggregate, which each micro-batch writes as a table of its own."""
    folder = shared_folder(spark, "stream")
    done = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        done.append(number)

    W.run_available(df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/state/batch={max(done)}")


@query("str1_str2_drained_stream", PRE + "SELECT run, sig, i, v FROM w")
def str1(spark, sf):
    out = shared_folder(spark, "stream")
    writer = stream(spark, sf).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
    W.run_available(writer)
    return spark.read.parquet(f"{out}/rows").select("run", "sig", "i", "v")


@query("str3_stream_range", PRE + "SELECT run, sig, min(v) AS lo, max(v) AS hi, count(*) AS n FROM w GROUP BY run, sig")
def str3(spark, sf):
    return _table(spark, W.stream_range(arriving(spark, sf)), "complete")


@query("str4_stream_progress", PRE + "SELECT run, round(max(t), 6) AS t, count(*) AS accepted FROM w GROUP BY run")
def str4(spark, sf):
    return _table(spark, W.stream_progress(arriving(spark, sf)), "complete").select("run", rounded("t"), "accepted")


@query("str5_stream_capture", PRE + "SELECT run, sig, i FROM w WHERE sig IN ('click', 'view')")
def str5(spark, sf):
    out = shared_folder(spark, "stream")
    kept = W.stream_capture(stream(spark, sf), [M.Spec("a", "trig", "click", other="view")])
    W.run_available(kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").select("run", "sig", "i")


@query(
    "str6_stream_crossings",
    PRE + f""", c AS (SELECT run, sig, i, t, t1, v - {LEVEL} AS a, v1 - {LEVEL} AS b FROM s WHERE t1 > t0 AND t < tn)
    SELECT run, sig, i, round(t - a * (t1 - t) / (b - a), 4) AS x FROM c WHERE (a < 0 AND b >= 0) OR (a > 0 AND b <= 0)""",
)
def str6(spark, sf):
    out = shared_folder(spark, "stream")
    W.run_available(W.stream_crossings(arriving(spark, sf), out, LEVEL))
    return W.read_crossings(spark, out).select("run", "sig", "i", rounded("x", 4))


@query(
    "str7_stream_integ",
    PRE + "SELECT run, sig, round(sum((v + v1) / 2 * (t1 - t)), 2) AS area, round(sum((v + v1) / 2 * (t1 - t)) / any_value(tn - t0), 6) AS avg FROM s GROUP BY run, sig",
)
def str7(spark, sf):
    out = shared_folder(spark, "stream")
    W.run_available(W.stream_integ(arriving(spark, sf), out))
    return W.read_integral(spark, out).select("run", "sig", rounded("area", 2), rounded("avg"))


# ten samples in a hundred are an hour back; each file is one micro-batch, so lateness is judged inside files and against what went before
BACK = PRE.replace("epoch_us(ts) -", "epoch_us(ts) - CASE WHEN event_id % 100 < 10 THEN 3600000000 ELSE 0 END -") + """,
    bound AS (SELECT min(event_id) AS a, max(event_id) + 1 AS b, greatest(4, (count(*) + 999999) // 1000000) AS parts FROM events),
    f AS (SELECT w.run, w.sig, w.i, w.t, len(list_filter(range(1, parts), lambda k: w.i >= a + (b - a) * k // parts)) AS batch FROM w, bound),
    top AS (SELECT run, sig, batch, max(t) AS t FROM f GROUP BY run, sig, batch),
    seen AS (SELECT f.*, (SELECT max(top.t) FROM top WHERE top.run = f.run AND top.sig = f.sig AND top.batch < f.batch) AS before FROM f),
    fresh AS (SELECT * FROM seen WHERE before IS NULL OR t > before),
    along AS (SELECT *, lag(t) OVER (PARTITION BY run, sig, batch ORDER BY i) AS t_prev FROM fresh)
"""


def backwards(spark, sf):
    back = F.when(F.col("event_id") % 100 < 10, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    return arriving(spark, sf, lambda e: e.withColumn("ts", F.col("ts") - back))


@query(
    "str4_str9_run_status",
    BACK + """
    SELECT run, round(max(t), 6) AS t, count(*) FILTER (before IS NULL OR t > before) AS accepted, count(*) FILTER (t <= before) AS rejected, 'DONE' AS status
    FROM seen GROUP BY run""",
)
def str9(spark, sf):
    out = shared_folder(spark, "stream")
    q = W.run_available(W.stream_monotonic(backwards(spark, sf), out))
    return W.read_runs(spark, out, q).select("run", rounded("t"), "accepted", "rejected", "status")


@query(
    "str8_str9_stream_monotonic",
    BACK + """
    SELECT (SELECT count(*) FROM seen WHERE t <= before) + (SELECT count(*) FROM along WHERE t < t_prev) AS violations, 'DONE' AS status""",
)
def str8(spark, sf):
    out = shared_folder(spark, "stream")
    q = W.run_available(W.stream_monotonic(backwards(spark, sf), out))
    return W.read_violations(spark, out).agg(F.count(F.lit(1)).alias("violations")).withColumn("status", F.lit(W.status(q)))
