"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.plans.lineage import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; the root is the least node.

    Alternates two steps: every node hands its larger neighbours to the least one
    it sees, then does the same with its smaller neighbours. The edges shrink to
    stars in a number of rounds that grows with the logarithm of the longest
    path. No step collects a neighbourhood; hubs are joined, not gathered. A
    round's table is deleted when the next one stands.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    loops = pairs.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"))
    e = cut(pairs.where(F.col("u") != F.col("v")).distinct())
    while True:
        before, e = e, cut(_to_smaller(_to_larger(e)))
        discard(before)
        if _is_stars(e):
            break
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    every = found.unionByName(roots)
    alone = loops.distinct().join(every, "node", "left_anti").select("node", F.col("node").alias("root"))
    return every.unionByName(alone)


def _to_larger(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _to_smaller(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Every node has one root and no root has a root."""
    sides = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                    F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = e.select(F.inline(sides)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count() == 0
