"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get
equal integer names: blocks are dealt into many small buckets by a hash, each
bucket is sorted, and a name is (bucket, rank in the bucket). Then adjacent pairs
of names are named the same way, which halves every document, until each document
has one name. Names are compared as whole blocks or pairs, never as hashes alone,
so two documents share their identity exactly when their texts are equal.

Block texts are shuffled once; all later rounds move a few integers per block.
The thousand most frequent blocks (pairs) are counted first, named in a table of
that size, and then bypass the buckets, so no bucket is filled by one key. Each round is a
written table, so a lost executor costs tasks of one round only.

Defined results: a null text counts as empty, and all empty texts are equal.
Of equal texts the row with the most code points stays, then the smallest id
(null is smallest), then one arbitrary row of those that agree in both; ``kept``
is true for exactly one row of each group even when ids repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwave.llm.common import SPACE, text_of
from sparkwave.plans.lineage import cut

BLOCK_BYTES = 2048
#: The most frequent keys that are named apart from the buckets.
HOT_KEYS = 1000
_HOT_ROWS = 64
_BUCKET_BITS = 20
_RANK_BITS = 40


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _hot_names(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Negative names of the most frequent keys: at most ``HOT_KEYS`` hashes go through the driver."""
    spark = rows.sparkSession
    counted = rows.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= _HOT_ROWS)
    hot = [r["_h"] for r in counted.orderBy(F.desc("_n"), "_h").limit(HOT_KEYS).collect()]
    if not hot:
        return None
    found = rows.where(F.xxhash64(*keys).isin(hot)).select(*keys).distinct()
    listed = sorted(tuple(r) for r in found.collect())
    named = [(*key, -1 - k) for k, key in enumerate(listed)]
    return spark.createDataFrame(named, found.schema.add("_hot", "long"))


def _name(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the columns ``keys`` by ``name``: equal keys, equal names. ``rid`` deals out the hot rows."""
    hot = _hot_names(rows, keys)
    if hot is None:
        rows = rows.withColumn("_hot", F.lit(None).cast("long"))
    else:
        rows = rows.join(F.broadcast(hot), keys, "left")
    cold = F.col("_hot").isNull()
    dealt = F.when(cold, F.shiftrightunsigned(F.xxhash64(*keys), 64 - _BUCKET_BITS)).otherwise(F.pmod("rid", F.lit(1 << _BUCKET_BITS)))
    rows = rows.select("rid", "pos", "left_over", "info", "_hot", dealt.alias("_bucket"), *[F.when(cold, F.col(k)).alias(k) for k in keys])
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*keys))
    name = F.coalesce("_hot", F.shiftleft("_bucket", _RANK_BITS) + rank)
    return rows.select("rid", "pos", "left_over", "info", name.alias("name"))


def _blocks(df: DataFrame, id: str, text: str, block_bytes: int) -> DataFrame:
    """One row per block; the first block of a document carries its id, length and digest."""
    t = normalised(F.col("t"))
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).alias("id"), text_of(text).alias("t"))
    docs = docs.select("rid", F.struct("id", F.length("t").alias("chars"), F.sha2(t, 256).alias("sha256")).alias("info"), F.encode(t, "UTF-8").alias("b"))
    last = F.greatest(F.ceil(F.octet_length("b") / block_bytes) - 1, F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last)
    cut_up = F.transform(starts, lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = docs.select("rid", "info", last.alias("left_over"), F.posexplode(cut_up).alias("pos", "block"))
    return rows.withColumn("info", F.when(F.col("pos") == 0, F.col("info")))


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``chars``."""
    rows, keys, level, done = _blocks(df, id, text, block_bytes), ["block"], 0, []
    while True:
        named = cut(_name(rows, keys))
        single = F.col("left_over") == 0
        done.append(named.where(single).select("rid", "info.*", F.lit(level).alias("level"), "name"))
        more = named.where(~single)
        if more.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        first = F.col("pos") % 2 == 0
        rows = more.groupBy("rid", half.alias("half"), F.floor(F.col("left_over") / 2).cast("int").alias("left_over")).agg(
            F.max(F.when(first, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(0)).cast("long").alias("b"),
            F.max("info").alias("info"),
        )
        rows, keys, level = rows.withColumnRenamed("half", "pos"), ["a", "b"], level + 1
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id"), F.col("rid"))
    groups = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
    groups = cut(groups.where("group_size > 1"))
    out = named.join(groups, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("best.rid"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "chars",
    )


def drop_copies(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns."""
    # a row is one value here, so that its columns may have any name
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own, t = F.col("row").getField(id), F.coalesce(F.col("row").getField(text), F.lit(""))
    sha, chars = F.sha2(normalised(t), 256).alias("sha"), F.length(t).alias("chars")
    stay = classes(df, id, text).where("kept").select(F.col(id).alias("id"), F.col("text_sha256").alias("sha"), "chars", "group_size")
    named = df.select(row.alias("row")).select("row", own.alias("own"), sha, chars)
    found = named.join(stay, F.col("own").eqNullSafe(F.col("id")) & (named["sha"] == stay["sha"]) & (named["chars"] == stay["chars"])).drop(stay["sha"])
    alone = found.where("group_size = 1").select("row.*")
    # rows that agree in id, text and length are one document
    first = found.where("group_size > 1").dropDuplicates(["own", "sha"]).select("row.*")
    return alone.unionByName(first)
