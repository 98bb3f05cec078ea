"""Named measuring points bound to whatever signals a run has.

Names compare without case. A probe on something a run lacks is reported; it
never reads another signal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.functions.names import GROUND_NAMES, is_ground
from sparkwave.functions.scalar import _c
from sparkwave.plans.lineage import cut
from sparkwave.plans.sizing import broadcast_if_small


@dataclass(frozen=True)
class Probe:
    id: str
    kind: str = "voltage"
    target: str | None = None
    target2: str | None = None
    label: str | None = None
    enabled: bool = True


TYPES = {"id": "string", "kind": "string", "target": "string", "target2": "string", "label": "string", "enabled": "boolean"}


def _table(spark, probes: Sequence[Probe] | DataFrame) -> DataFrame:
    """Probes as rows, one per probe; a table that a user wrote stays one and is not read by the driver."""
    if not isinstance(probes, DataFrame):
        return spark.createDataFrame([astuple(p) for p in probes], ", ".join(f"{n} {t}" for n, t in TYPES.items()))
    preset = {"kind": "voltage", "enabled": True}
    value = lambda n, t: F.coalesce(
        (F.col(n) if n in probes.columns else F.lit(None)).cast(t), F.lit(preset.get(n)).cast(t)
    ).alias(n)
    return probes.select(*[value(n, t) for n, t in TYPES.items()])


def _terms() -> Column:
    """Signals a probe adds up, with their sign; ground adds nothing."""
    kind, name = F.col("kind"), lambda c: F.lower(F.coalesce(c, F.lit("none")))
    term = lambda c, sign: F.struct(name(c).alias("_key"), F.lit(sign).alias("sign"))
    branch = F.format_string("i(%s)", F.coalesce("target", F.lit("none")))
    nodes = F.array(term(F.col("target"), 1), F.when(kind == "differential", term(F.col("target2"), -1)))
    live = F.filter(nodes, lambda t: t.isNotNull() & ~t["_key"].isin(*GROUND_NAMES))
    return F.when(kind == "current", F.array(term(branch, 1))).otherwise(live)


def probe_label(kind="kind", target="target", target2="target2") -> Column:
    k, a, b = _c(kind), _c(target), _c(target2)
    return (
        F.when(k == "current", F.format_string("I(%s)", a))
        .when(k == "differential", F.format_string("V(%s,%s)", a, b))
        .otherwise(F.format_string("V(%s)", a))
    )


def resolve_probes(waves: DataFrame, probes: Sequence[Probe] | DataFrame) -> DataFrame:
    """``(run, id, i, t, v, unit)``: the reading of each probe at each row of its run."""
    unit = F.when(F.col("kind") == "current", "A").otherwise("V").alias("unit")
    asked = _table(waves.sparkSession, probes).select("id", unit, _terms().alias("_terms"))
    sizes = [r[0] for r in asked.select(F.size("_terms")).distinct().collect()]  # at most 0, 1 and 2
    parts = []
    if 1 in sizes:
        tagged = _tag(waves, asked.where(F.size("_terms") == 1))
        parts.append(tagged.select("run", "id", "i", "t", (F.col("v") * F.col("sign")).alias("v"), "unit"))
    if 2 in sizes:
        pair = (
            _tag(waves, asked.where(F.size("_terms") == 2))
            .groupBy("run", "id", "i")
            .agg(
                F.min("t").alias("t"),
                F.max(F.when(F.col("sign") > 0, F.col("v"))).alias("_a"),
                F.max(F.when(F.col("sign") < 0, F.col("v"))).alias("_b"),
                F.count_distinct("sign").alias("_sides"),
                F.first("unit").alias("unit"),
            )
            .where(F.col("_sides") == 2)
        )
        parts.append(pair.select("run", "id", "i", "t", (F.col("_a") - F.col("_b")).alias("v"), "unit"))
    if 0 in sizes:
        grounded = asked.where(F.size("_terms") == 0).select("id")
        steps = waves.groupBy("run", "i").agg(F.min("t").alias("t"))
        parts.append(
            _with_each(steps, grounded).select("run", "id", "i", "t", F.lit(0.0).alias("v"), F.lit("V").alias("unit"))
        )
    if not parts:
        return waves.limit(0).select("run", F.lit("").alias("id"), "i", "t", "v", F.lit("").alias("unit"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tag(waves: DataFrame, asked: DataFrame) -> DataFrame:
    mine = broadcast_if_small(asked.select("id", "unit", F.inline("_terms")))
    return waves.join(mine, F.lower(waves["sig"]) == mine["_key"]).select("run", "i", "t", "v", "id", "sign", "unit")


def _with_each(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Every row with every probe, which is what the result holds; met by number, so tasks share the work."""
    stored = cut(asked)
    count = max(stored.count(), 1)
    names = [F.col(f"`{c}`") for c in stored.columns]
    numbered = broadcast_if_small(stored.withColumn("_n", F.pmod(F.xxhash64(*names), F.lit(count))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("_n")
    return rows.select("*", every).join(numbered, "_n").drop("_n")


def probe_status(waves: DataFrame, probes: Sequence[Probe] | DataFrame) -> DataFrame:
    """``(run, id, label, ok, reason)`` for every run and probe."""
    rows = _with_each(waves.select("run").distinct(), _table(waves.sparkSession, probes))
    have = waves.select("run", F.lower("sig").alias("_key")).distinct()
    a, b = F.col("target"), F.col("target2")
    branch = F.concat(F.lit("i("), a, F.lit(")"))
    for name, flag in ((F.when(F.col("kind") == "current", branch).otherwise(a), "_a"), (b, "_b")):
        side = have.withColumn(flag, F.lit(True))
        rows = rows.withColumn("_key", F.lower(name)).join(side, ["run", "_key"], "left").drop("_key")
    lacks = lambda flag: F.col(flag).isNull()
    gone = lambda n: F.concat(F.lit("no such net: "), n)
    reason = (
        F.when(F.col("kind") == "current", F.when(lacks("_a"), F.concat(F.lit("no branch current: "), a)))
        .when(~is_ground(a) & lacks("_a"), gone(a))
        .when((F.col("kind") == "differential") & ~is_ground(b) & lacks("_b"), gone(b))
    )
    label = F.coalesce("label", probe_label())
    return rows.select("run", "id", label.alias("label"), reason.isNull().alias("ok"), reason.alias("reason"))


def routed(probes: DataFrame, routes: DataFrame, consumer: str) -> DataFrame:
    """Enabled probes that one consumer subscribes to."""
    wanted = routes.where(F.col("instrument") == consumer).select(F.col("probe_id").alias("id")).distinct()
    return probes.where(F.coalesce("enabled", F.lit(True))).join(wanted, "id", "left_semi")
