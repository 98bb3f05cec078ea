"""Sweep and Monte Carlo case tables: making, evaluating and summarising them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwave.functions import draws as D
from sparkwave.functions import grids as G
from sparkwave.functions.scalar import _c, bound
from sparkwave.operators import samples as S
from sparkwave.plans import chunks as C

PERCENTS = (1, 50, 99)


def sample_sets(spark: SparkSession, spec: Sequence[tuple[str, float, float, str]], trials: int, seed: int = 1) -> DataFrame:
    """``(case_id, params)``: one toleranced value per parameter and trial.

    ``spec`` lists ``(name, nominal, tol, dist)``; parameters are drawn in that
    order inside a trial, so a trial starts at ``case_id * draws per trial``.
    """
    per_trial = sum(D.draws_of(dist) for *_, dist in spec)
    pairs, used = [], 0
    for name, nominal, tol, dist in spec:
        first = F.col("id") * per_trial + used
        pairs += [F.lit(name), D.toleranced(F.lit(float(nominal)), F.lit(float(tol)), dist, F.lit(seed), first)]
        used += D.draws_of(dist)
    return spark.range(trials).select(F.col("id").alias("case_id"), F.create_map(*pairs).alias("params"))


def sweep_cases(spark: SparkSession, name: str, start: float, stop: float, points: int = 10, scale: str = "lin") -> DataFrame:
    """One case per value, numbered in order; values are computed by the tasks that hold their numbers."""
    value = G.sweep_value(F.col("id"), F.lit(start), F.lit(stop), F.lit(points), scale)
    return spark.range(max(2, int(points))).select(F.col("id").alias("case_id"), F.create_map(F.lit(name), value).alias("params"))


def nested_cases(outer: Column, inner: Column, names: tuple[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Every outer value with every inner value, as rows of the given table.

    Both grids are array columns, so the product is two nested explodes.
    """

    def expand(df: DataFrame) -> DataFrame:
        kept = df.columns
        a = df.select(*kept, F.posexplode(outer).alias("_po", names[0]))
        return a.select(*kept, "_po", names[0], F.posexplode(inner).alias("_pi", names[1])).select(
            *kept, F.col("_po").cast("long").alias("outer_ix"), F.col("_pi").cast("long").alias("inner_ix"), *names
        )

    return expand


def apply_overrides(defaults: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Case values replace default ones of the same name; both are ``params`` maps."""
    d = defaults.withColumnRenamed("params", "_default")
    return d.join(cases, list(keys)).withColumn("params", override_map("_default", "params")).drop("_default")


def override_map(default, override) -> Column:
    """Right side wins on equal keys."""
    d, o = _c(default), _c(override)
    own = lambda names: F.map_filter(d, lambda k, _: ~F.array_contains(names, k))
    return bound(o, lambda given: F.map_concat(bound(F.map_keys(given), own), given))


def evaluate_cases(
    cases: DataFrame, responses: Mapping[str, Column], guard: Column | None = None, keys: Sequence[str] = ("case_id",)
) -> DataFrame:
    """``(case_id, ok, error, name, value)``: closed-form responses of every case.

    ``guard`` is NULL or the reason why a case cannot be evaluated. A failed
    case is a row, never an exception; a response that comes out NULL or NaN
    fails only itself.
    """
    why = (guard if guard is not None else F.lit(None)).cast("string")
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.when(why.isNull(), c).cast("double").alias("_v")) for n, c in responses.items()])
    long = cases.select(*keys, why.alias("_why"), F.inline(items))
    usable = F.col("_v").isNotNull() & ~F.isnan("_v")
    error = F.coalesce(F.col("_why"), F.when(~usable, F.lit("no value")))
    return long.select(
        *keys, error.isNull().alias("ok"), error.alias("error"), "name", F.when(usable, F.col("_v")).alias("value")
    )


def evaluate_cases_with(cases: DataFrame, fn: Callable[[dict], Mapping[str, float]], key: str = "case_id") -> DataFrame:
    """As ``evaluate_cases`` for a response that only Python can compute.

    Runs on Arrow batches inside the tasks; an exception fails its case alone.
    """

    def run(batches):
        for batch in batches:
            out = []
            for case, params in zip(batch[key], batch["params"]):
                try:
                    got = {k: float(v) for k, v in fn(dict(params)).items()}
                    out += [(case, True, None, k, v) for k, v in got.items()]
                except Exception as e:  # noqa: BLE001 - the failure is the result
                    out.append((case, False, str(e), None, None))
            yield pd.DataFrame(out, columns=[key, "ok", "error", "name", "value"])

    return cases.select(key, "params").mapInPandas(run, f"{key} long, ok boolean, error string, name string, value double")


def finite_ok(results: DataFrame) -> DataFrame:
    """Cases that ran and gave a finite number."""
    v = F.col("value")
    return results.where(F.col("ok") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def exact_ranks(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float], rows_per_chunk: int | None = None
) -> DataFrame:
    """``(keys, p, v)``: the value at rank round(p/100*(n-1)) of each key, exactly.

    Equal values are merged first. The distinct values of a large key are cut
    along the value axis and only the pieces that hold a wanted rank are sorted.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    split = C.plan_chunks(counted, keys, value, None, rows_per_chunk)
    keyed = split.assign(counted, value)
    pieces = keyed.groupBy(*keys, C.CHUNK).agg(F.sum("_w").alias("_pw"))
    along = Window.partitionBy(*keys).orderBy(C.CHUNK)
    pieces = pieces.withColumn("_upto", F.sum("_pw").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("_pw").over(Window.partitionBy(*keys))
    # ranks from 0, halves up
    rank = lambda p: F.floor(F.lit(p / 100.0) * (F.col("_total") - 1) + 0.5)
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(p).alias("r")) for p in percents])
    holding = (
        pieces.withColumn("_total", total)
        .withColumn("_before", F.col("_upto") - F.col("_pw"))
        .withColumn("_want", F.filter(wanted, lambda w: (w["r"] >= F.col("_before")) & (w["r"] < F.col("_upto"))))
        .where(F.size("_want") > 0)
        .select(*keys, C.CHUNK, "_before", "_want")
    )
    inside = C.piece_window(keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = keyed.join(holding, [*keys, C.CHUNK]).withColumn("_cum", F.col("_before") + F.sum("_w").over(inside))
    hit = F.filter("_want", lambda w: (w["r"] < F.col("_cum")) & (w["r"] >= F.col("_cum") - F.col("_w")))
    return cum.select(*keys, F.col(value).alias("v"), F.explode(hit).alias("_h")).select(*keys, F.col("_h.p").alias("p"), "v")


def summarize(
    results: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ("name",), rows_per_chunk: int | None = None
) -> DataFrame:
    """n, mean, sample deviation, range and exact p1/p50/p99 of every measurement.

    A name in ``names`` without a usable value gets a row of NULLs.
    """
    good = finite_ok(results)
    base = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    ranks = exact_ranks(good, keys, "value", PERCENTS, rows_per_chunk)
    picks = ranks.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in PERCENTS])
    out = base.join(picks, list(keys))
    if names is not None:
        spark = results.sparkSession
        asked = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
        out = asked.join(out, "name", "left")
    return out


def sweep(spark, name, start, stop, points, scale, responses, guard=None) -> tuple[DataFrame, DataFrame]:
    """Values of one parameter, their responses, and the summary."""
    cases = sweep_cases(spark, name, start, stop, points, scale)
    results = evaluate_cases(cases, responses, guard)
    return results, summarize(results, list(responses))


def monte_carlo(spark, spec, trials, seed, responses, guard=None) -> tuple[DataFrame, DataFrame]:
    """Toleranced parameters, their responses, and the summary."""
    results = evaluate_cases(sample_sets(spark, spec, trials, seed), responses, guard)
    return results, summarize(results, list(responses))


def param(name: str) -> Column:
    return F.try_element_at(F.col("params"), F.lit(name))


# ------------------------------------------------------------------ step specifications


def validate_steps(steps: DataFrame) -> DataFrame:
    """Turn step rows into values or a refusal.

    Columns: ``deck, ord, param, kind (range|list|lin|dec|oct), points, start,
    stop, step, list``. Device parameters and temperature are refused, and so is
    every step after the first of a deck.
    """
    kind = F.lower("kind")
    missing = lambda *cs: F.greatest(*[F.col(c).isNull() for c in cs])
    n = F.greatest(F.round("points"), F.lit(1.0))
    logs = lambda k: G.grid_log(k, n, F.col("start"), F.col("stop"))
    positive = (F.col("start") > 0) & (F.col("stop") > 0)
    values = (
        F.when(kind == "list", G.grid_list(F.col("list")))
        .when(kind == "lin", G.grid_lin(n, F.col("start"), F.col("stop")))
        .when(kind == "dec", logs("dec"))
        .when(kind == "oct", logs("oct"))
        .otherwise(G.grid_range("start", "stop", "step"))
    )
    error = (
        F.when(F.coalesce(F.trim("param"), F.lit("")) == "", F.lit("no parameter to sweep"))
        .when(F.contains(F.col("param"), F.lit(":")), F.lit("device parameters cannot be swept"))
        .when(F.lower("param").isin("temp", "temper"), F.lit("temperature cannot be swept"))
        .when((kind == "list") & (F.size(G.grid_list(F.coalesce("list", F.array().cast("array<double>")))) == 0), F.lit("the list has no usable values"))
        .when(kind.isin("lin", "dec", "oct") & missing("points", "start", "stop"), F.lit("points, start and stop are needed"))
        .when(kind.isin("dec", "oct") & ~positive, F.lit("start and stop must be positive"))
        .when(~kind.isin("list", "lin", "dec", "oct") & missing("start", "stop", "step"), F.lit("start, stop and step are needed"))
    )
    first = steps.groupBy("deck").agg(F.min("ord").alias("_first"))
    later = F.when(F.col("ord") > F.col("_first"), F.lit("nested steps are not implemented"))
    both = F.coalesce(error, later)
    return steps.join(first, "deck").select(
        "deck", "ord", "param",
        F.when(both.isNull(), values).otherwise(F.array().cast("array<double>")).alias("values"),
        both.alias("error"),
    )
