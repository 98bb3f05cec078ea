"""Numbers out of waveforms: many measurements over many runs in one pass.

Time aggregates are integrals over time divided by the span, never means of the
samples, because samples are packed where a waveform moves. Crossing times are
interpolated. A measurement that cannot be made is a row with ``error`` set.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import MISSING as NO_DEFAULT
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwave.operators import samples as S
from sparkwave.plans import chunks as C
from sparkwave.plans.lineage import cut
from sparkwave.plans.sizing import BROADCAST_ROWS, broadcast_if_small

@dataclass(frozen=True)
class Spec:
    """One measurement.

    ``sig`` is the measured signal. WHEN takes ``level`` or ``other`` (a second
    signal); FIND takes ``at``, or ``other`` with ``level`` as its condition;
    TRIG goes from (sig, level, edge, nth) to (other, level2, edge2, nth2).
    """

    name: str
    func: str
    sig: str
    other: str | None = None
    level: float | None = None
    edge: str = "cross"
    nth: int = 1
    t_from: float | None = None
    t_to: float | None = None
    at: float | None = None
    level2: float | None = None
    edge2: str = "cross"
    nth2: int = 1


SPEC_TYPES = {
    "name": "string", "func": "string", "sig": "string", "other": "string", "level": "double",
    "edge": "string", "nth": "long", "t_from": "double", "t_to": "double", "at": "double",
    "level2": "double", "edge2": "string", "nth2": "long",
}
AREA = ("avg", "rms", "integ")
EXTREME = ("max", "min", "pp")
WINDOWED = (*AREA, *EXTREME, "deriv")
LAST = ("final", "nearest")
KNOWN = (*WINDOWED, *LAST, "when", "find", "trig")
OUTPUT = ("run", "name", "func", "value", "unit", "error")

NO_WINDOW = "no samples between the window's ends"
NO_TRIG = "the first crossing is not there"
NO_TARG = "the second crossing is not there"
MISSING = "samples are missing in the window"
NO_WHEN = "the condition never occurred in the window"
TOO_SHORT = "a measurement needs at least two points"


def needed_signals(specs: Iterable[Spec]) -> list[str]:
    """Signals that some measurement names; the only ones worth reading."""
    return sorted({s.lower() for spec in specs for s in (spec.sig, spec.other) if s})


def capture(waves: DataFrame, specs: Iterable[Spec] | DataFrame) -> DataFrame:
    """Samples of the signals that some measurement names; a table of measurements is joined, not read."""
    if not isinstance(specs, DataFrame):
        return waves.where(F.lower("sig").isin(needed_signals(specs)))
    other = F.col("other") if "other" in specs.columns else F.lit(None).cast("string")
    return _named(waves, specs.select(F.explode(F.array("sig", other)).alias("_key")))


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose signal is among ``names(_key)``."""
    wanted = broadcast_if_small(names.select(F.lower("_key").alias("_key")).dropna().distinct())
    return rows.join(wanted, F.lower(rows["sig"]) == wanted["_key"], "left_semi")


@dataclass(frozen=True)
class _Plan:
    """Measurements as rows ``(_n, s)``, with ``_n`` below ``count``.

    The driver knows only how many there are and of which kinds. ``listed`` holds
    them when they were given as a list, else None.
    """

    table: DataFrame
    count: int
    kinds: frozenset[str]
    listed: tuple[Spec, ...] | None


PAIR, FIND_AT, FIND_WHEN = "when pair", "find at", "find when"


def _kind(s: Column) -> Column:
    """What a measurement needs; NULL for a function that is not known."""
    func = s["func"]
    return (
        F.when((func == "find") & s["at"].isNotNull(), FIND_AT)
        .when(func == "find", FIND_WHEN)
        .when((func == "when") & _given(s["other"]) & s["level"].isNull(), PAIR)
        .when(func.isin(*KNOWN), func)
    )


def _given(name: Column) -> Column:
    return F.coalesce(name, F.lit("")) != ""


def _plan(spark, specs: Sequence[Spec] | DataFrame) -> _Plan:
    inner = ", ".join(f"{n}: {t}" for n, t in SPEC_TYPES.items())
    if isinstance(specs, DataFrame):
        return _plan_of_table(specs)
    listed = tuple(s if isinstance(s, Spec) else Spec(**s) for s in specs)
    if any(s.nth < 1 or s.nth2 < 1 for s in listed):
        raise ValueError("nth counts from 1")
    rows = [(k, _typed(s)) for k, s in enumerate(listed)]
    table = spark.createDataFrame(rows, f"_n long, s struct<{inner}>")
    return _Plan(table, len(listed), frozenset(filter(None, map(_kind_of, listed))), listed)


def _kind_of(s: Spec) -> str | None:
    if s.func == "find":
        return FIND_WHEN if s.at is None else FIND_AT
    if s.func == "when" and s.other and s.level is None:
        return PAIR
    return s.func if s.func in KNOWN else None


def _plan_of_table(df: DataFrame) -> _Plan:
    """A table that a user wrote, one row per measurement; missing columns and NULLs take the defaults of ``Spec``."""
    preset = {f.name: f.default for f in fields(Spec) if f.default is not NO_DEFAULT}
    value = lambda n, t: F.coalesce(
        (F.col(n) if n in df.columns else F.lit(None)).cast(t), F.lit(preset.get(n)).cast(t)
    ).alias(n)
    stored = cut(df.select(F.struct(*[value(n, t) for n, t in SPEC_TYPES.items()]).alias("s")))
    s = F.col("s")
    facts = stored.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("s.nth", "s.nth2")).alias("least"), F.collect_set(_kind(s)).alias("kinds")
    ).first()
    if facts["n"] and facts["least"] < 1:
        raise ValueError("nth counts from 1")
    number = F.pmod(F.xxhash64("s"), F.lit(max(facts["n"], 1))).alias("_n")
    return _Plan(stored.select(number, "s"), facts["n"], frozenset(facts["kinds"]), None)


def _typed(spec: Spec) -> tuple:
    """A number given as an integer is a double in the table."""
    return tuple(float(v) if t == "double" and v is not None else v for t, v in zip(SPEC_TYPES.values(), astuple(spec)))


def _per_spec(rows: DataFrame, specs: DataFrame, role: Column) -> DataFrame:
    """Rows of a signal repeated for each measurement that reads it in this role."""
    mine = broadcast_if_small(specs.select(F.lower(role).alias("_key"), "s"))
    return rows.join(mine, F.lower(rows["sig"]) == mine["_key"]).drop("_key")


def measure(waves: DataFrame, specs: Sequence[Spec] | DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """``(run, name, func, value, unit, error)`` for every run and measurement.

    Exactly one of ``value`` and ``error`` is set.
    """
    plan = _plan(waves.sparkSession, specs)
    kind = _kind(F.col("s"))
    used = capture(waves, plan.listed if plan.listed is not None else plan.table.select("s.sig", "s.other"))
    if PAIR in plan.kinds:
        used = used.unionByName(_differences(used, plan.table.where(kind == PAIR)), allowMissingColumns=True)
    rows, split = S.samples(used, rows_per_chunk=rows_per_chunk)

    parts = []
    if plan.kinds & {*WINDOWED, *LAST, FIND_AT}:
        parts.append(_aggregates(rows, plan.table.where(kind.isin(*WINDOWED, *LAST, FIND_AT)), plan.kinds))
    if plan.kinds & {"when", PAIR, FIND_WHEN}:
        parts.append(_when_find(rows, plan.table.where(kind.isin("when", PAIR, FIND_WHEN)), split, plan.kinds))
    if "trig" in plan.kinds:
        parts.append(_delays(rows, plan.table.where(kind == "trig"), split))
    found = parts[0] if parts else None
    for part in parts[1:]:
        found = found.unionByName(part)
    return _with_errors(waves, plan, found)


def _difference_name(s: Column) -> Column:
    return F.lower(F.concat(s["sig"], F.lit("-"), s["other"]))


def _differences(waves: DataFrame, pairs: DataFrame) -> DataFrame:
    """A minus B at the same row of the run, as a signal of its own."""
    s = F.col("s")
    side = lambda name, sign: F.struct(F.lower(name).alias("_key"), F.lit(sign).alias("_sign"))
    both = F.explode(F.array(side(s["sig"], 1), side(s["other"], -1))).alias("_e")
    sides = broadcast_if_small(pairs.select(_difference_name(s).alias("_name"), both).select("_name", "_e.*").distinct())
    of = lambda sign: F.max(F.when(F.col("_sign") == sign, F.col("v")))
    made = (
        waves.join(sides, F.lower(waves["sig"]) == sides["_key"])
        .groupBy("run", F.col("_name").alias("sig"), "i")
        .agg(F.min("t").alias("t"), (of(1) - of(-1)).alias("v"))
    )
    return made.where(F.col("v").isNotNull())


def _aggregates(rows: DataFrame, specs: DataFrame, kinds: frozenset[str]) -> DataFrame:
    """All window aggregates, slopes, point reads and last values in one group-by."""
    r = _per_spec(rows, specs, F.col("s.sig"))
    low, high, t, v = F.col("s.t_from"), F.col("s.t_to"), F.col("t"), F.col("v")
    in_window = S.touches_window(low, high)
    inside = (
        (t >= S.lower_end(low)) & (t <= S.upper_end(high))
        & (F.col("x_next").isNull() | (F.col("x_next") > S.lower_end(low)))
        & (F.col("x_prev").isNull() | (F.col("x_prev") < S.upper_end(high)))
    )
    squared = S.clipped_area(low, high, lambda a: a * a)
    plain = S.clipped_area(low, high)
    area = F.when(F.col("s.func") == "rms", squared).otherwise(plain)
    # the slope of DERIV is taken at the window end unless a place is given
    x = F.coalesce(F.col("s.at"), high, F.lit(float("inf")))
    seg = F.when(F.col("x_next").isNotNull(), F.struct("t", "i", "v", "x_next", "v_next"))
    sample = F.struct("t", "i", "v")
    # plain numbers aggregate by hash; rows as values need a sort, so only if asked for
    numbers = [
        F.max("s.t_from").alias("t_from"),
        F.max("s.t_to").alias("t_to"),
        F.max("s.at").alias("at"),
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("t0"),
        F.max("t").alias("tn"),
        F.sum(F.when(in_window, area)).alias("area"),
        F.count_if(in_window & (v.isNull() | F.col("v_next").isNull())).alias("missing"),
        F.min(F.when(inside, v)).alias("lo"),
        F.max(F.when(inside, v)).alias("hi"),
    ]
    if kinds & {"deriv", FIND_AT}:
        numbers += [F.max(F.when(t < x, seg)).alias("seg"), F.min(seg).alias("first_seg")]
    if kinds & set(LAST):
        near = F.min_by("v", F.struct(F.abs(t - F.col("s.at")), F.col("i")))
        numbers += [F.max(sample).alias("last"), near.alias("near")]
    g = r.groupBy("run", F.col("s.name").alias("name"), F.col("s.func").alias("func")).agg(*numbers)
    raw_lo = F.coalesce("t_from", "t0")
    raw_hi = F.coalesce("t_to", "tn")
    lo = F.greatest(raw_lo, F.col("t0"))
    hi = F.least(raw_hi, F.col("tn"))
    good = (raw_hi > raw_lo) & (raw_lo < F.col("tn")) & (raw_hi > F.col("t0"))
    func = F.col("func")
    value = (
        F.when(func == "integ", F.col("area"))
        .when(func == "avg", F.try_divide(F.col("area"), hi - lo))
        .when(func == "rms", F.sqrt(F.try_divide(F.col("area"), hi - lo)))
        .when(func == "max", F.col("hi"))
        .when(func == "min", F.col("lo"))
        .when(func == "pp", F.col("hi") - F.col("lo"))
    )
    if kinds & {"deriv", FIND_AT}:
        hit = F.coalesce("seg", "first_seg")
        slope = F.when(
            hit["x_next"] > hit["t"], (hit["v_next"] - hit["v"]) / (hit["x_next"] - hit["t"])
        ).otherwise(0.0)
        read = S.lerp(F.col("at"), hit["t"], hit["v"], hit["x_next"], hit["v_next"])
        value = value.when(func == "deriv", slope).when(func == "find", read)
    if kinds & set(LAST):
        value = value.when(func == "final", F.col("last.v")).when(func == "nearest", F.col("near"))
    free = func.isin(*LAST)
    usable = free | ((F.col("n") >= 2) & good)
    error = (
        F.when(~free & (F.col("n") < 2), F.lit(TOO_SHORT))
        .when(~free & ~good, F.lit(NO_WINDOW))
        .when(func.isin(*AREA) & (F.col("missing") > 0), F.lit(MISSING))
        .when(value.isNull(), F.lit(NO_WINDOW))
    )
    return g.select("run", "name", "func", F.when(usable & error.isNull(), value).alias("value"), error.alias("error"))


def _hits(rows: DataFrame, specs: DataFrame, split: C.Chunks, signal: Column, level, edge, nth, name: str) -> DataFrame:
    """The wanted crossing of each (run, measurement), with the window's verdict."""
    r = _per_spec(rows, specs, signal)
    low, high = F.col("s.t_from"), F.col("s.t_to")
    x = S.crossing_at(level, edge)
    found = (
        r.where(S.touches_window(low, high))
        .withColumn("x", x)
        .where(F.col("x").isNotNull())
        .where(F.col("x") >= S.lower_end(low) - S.EDGE_SLACK)
        .where(F.col("x") <= S.upper_end(high) + S.EDGE_SLACK)
        .select("run", F.col("s.name").alias("name"), C.CHUNK, "t", "i", "x", nth.alias("_nth"))
    )
    hit = C.nth_in_key(found, ["run", "name"], ["t", "i"], F.col("_nth"), split.split)
    return hit.select("run", "name", F.col("x").alias(name))


def _windows(rows: DataFrame, specs: DataFrame, signal: Column) -> DataFrame:
    """Whether the window of each (run, measurement) holds data."""
    r = _per_spec(rows, specs, signal)
    g = r.groupBy("run", F.col("s.name").alias("name")).agg(
        F.first("s").alias("s"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("tn")
    )
    raw_lo = F.coalesce(F.col("s.t_from"), F.col("t0"))
    raw_hi = F.coalesce(F.col("s.t_to"), F.col("tn"))
    good = (raw_hi > raw_lo) & (raw_lo < F.col("tn")) & (raw_hi > F.col("t0"))
    return g.select("run", "name", "s", "n", good.alias("good"))


def _crossed_signal(s: Column) -> Column:
    kind = _kind(s)
    return (
        F.when(kind == FIND_WHEN, F.coalesce(F.nullif(s["other"], F.lit("")), s["sig"]))
        .when(kind == PAIR, _difference_name(s))
        .otherwise(s["sig"])
    )


def _when_find(rows: DataFrame, specs: DataFrame, split: C.Chunks, kinds: frozenset[str]) -> DataFrame:
    level = F.coalesce(F.col("s.level"), F.lit(0.0))
    crossed = _crossed_signal(F.col("s"))
    hit = _hits(rows, specs, split, crossed, level, F.col("s.edge"), F.col("s.nth"), "x")
    seen = _windows(rows, specs, crossed).join(hit, ["run", "name"], "left")
    out = seen.where(F.col("s.func") == "when").select("run", "name", "s", "n", "good", F.col("x").alias("value"))
    if FIND_WHEN in kinds:
        asked = seen.where(F.col("s.func") == "find")
        points = asked.where(F.col("x").isNotNull()).select(
            "run", F.lower(F.col("s.sig")).alias("sig"), "name", "x"
        )
        targets = _named(rows, specs.where(_kind(F.col("s")) == FIND_WHEN).select(F.col("s.sig").alias("_key")))
        read = read_at(targets.withColumn("sig", F.lower("sig")).drop(C.CHUNK), points, split)
        got = read.select("run", "name", F.col("v").alias("value"))
        out = out.unionByName(
            asked.join(got, ["run", "name"], "left").select("run", "name", "s", "n", "good", "value")
        )
    error = (
        F.when(F.col("n") < 2, F.lit(TOO_SHORT))
        .when(~F.col("good"), F.lit(NO_WINDOW))
        .when(F.col("value").isNull(), F.lit(NO_WHEN))
    )
    return out.select(
        "run", "name", F.col("s.func").alias("func"), F.when(error.isNull(), F.col("value")).alias("value"),
        error.alias("error"),
    )


def _delays(rows: DataFrame, specs: DataFrame, split: C.Chunks) -> DataFrame:
    """Second crossing minus first; either may be missing, and says so."""
    level = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    first, second = F.col("s.sig"), F.col("s.other")
    start = _hits(rows, specs, split, first, level("s.level"), F.col("s.edge"), F.col("s.nth"), "x0")
    stop = _hits(rows, specs, split, second, level("s.level2"), F.col("s.edge2"), F.col("s.nth2"), "x1")
    both = (
        _windows(rows, specs, first)
        .join(start, ["run", "name"], "left")
        .join(stop, ["run", "name"], "left")
    )
    error = (
        F.when(F.col("n") < 2, F.lit(TOO_SHORT))
        .when(~F.col("good"), F.lit(NO_WINDOW))
        .when(F.col("x0").isNull(), F.lit(NO_TRIG))
        .when(F.col("x1").isNull(), F.lit(NO_TARG))
    )
    return both.select(
        "run", "name", F.lit("trig").alias("func"),
        F.when(error.isNull(), F.col("x1") - F.col("x0")).alias("value"), error.alias("error"),
    )


def _asked(waves: DataFrame, plan: _Plan) -> tuple[DataFrame, Column, Column]:
    """``(run, s, …)`` for every run and measurement, and whether the run has its two signals."""
    # every run asks for every measurement: the result has that many rows
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(plan.count, 1) - 1).cast("long"))).alias("_n")
    listed = broadcast_if_small(plan.table)
    if plan.listed is not None:
        low = F.lower("sig")
        have = waves.groupBy("run").agg(F.collect_set(F.when(low.isin(needed_signals(plan.listed)), low)).alias("_sigs"))
        asked = have.select("run", "_sigs", numbers).join(listed, "_n").drop("_n")
        knows = lambda c: c.isNull() | F.array_contains("_sigs", F.lower(c))
        return asked, knows(F.col("s.sig")), knows(F.col("s.other"))
    # a run of a large table may have many signals: they are joined, never gathered
    have = capture(waves, plan.table.select("s.sig", "s.other")).select("run", F.lower("sig").alias("_key")).distinct()
    asked = waves.select("run").distinct().select("run", numbers).join(listed, "_n").drop("_n")
    for name, flag in (("sig", "_a"), ("other", "_b")):
        side = have.withColumn(flag, F.lit(True))
        key = F.lower(F.col(f"s.{name}"))
        asked = asked.withColumn("_key", key).join(side, ["run", "_key"], "left").drop("_key")
    return asked, F.col("s.sig").isNull() | F.col("_a").isNotNull(), F.col("s.other").isNull() | F.col("_b").isNotNull()


def _with_errors(waves: DataFrame, plan: _Plan, found: DataFrame | None) -> DataFrame:
    """One row per run and measurement, whatever happened."""
    asked, has_sig, has_other = _asked(waves, plan)
    status = asked.select(
        "run",
        F.col("s.name").alias("name"),
        F.col("s.func").alias("func"),
        F.when(~F.col("s.func").isin(*KNOWN), F.concat(F.lit("measurement not implemented: "), F.col("s.func")))
        .when(~has_sig, F.concat(F.lit("unknown signal: "), F.col("s.sig")))
        .when(~has_other, F.concat(F.lit("unknown signal: "), F.col("s.other")))
        .alias("_bad"),
    )
    if found is None:
        found = status.select("run", "name", "func", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("error")).limit(0)
    joined = status.join(found, ["run", "name", "func"], "left")
    error = F.coalesce(F.col("_bad"), F.col("error"), F.when(F.col("value").isNull(), F.lit(NO_WINDOW)))
    return joined.select(
        "run", "name", "func",
        F.when(error.isNull(), F.col("value")).alias("value"),
        F.when(error.isNull() & F.col("func").isin("when", "trig"), F.lit("s")).alias("unit"),
        error.alias("error"),
    )


# ------------------------------------------------------------------ reading at points


def read_at(
    rows: DataFrame, points: DataFrame, split: C.Chunks, keys: Sequence[str] = S.KEYS, x: str = "x"
) -> DataFrame:
    """Interpolated value at each point, given samples with their neighbours.

    The segment is the first one that ends at or after the point, and the last
    segment beyond the data; there the line is extended and flagged.
    """
    segs = rows.where(F.col("x_next").isNotNull())
    hit = C.last_known(segs, points, keys, "t", "i", x, ["v", "x_next", "v_next"], split)
    h = F.col("_hit")
    return hit.select(
        *[c for c in hit.columns if c != "_hit"],
        S.lerp(F.col(x), h["_x"], h["v"], h["x_next"], h["v_next"]).alias("v"),
        F.when(h["x_next"] > h["_x"], (h["v_next"] - h["v"]) / (h["x_next"] - h["_x"])).otherwise(0.0).alias("slope"),
        ((F.col(x) < h["_x"]) | (F.col(x) > h["x_next"])).alias("extrapolated"),
        h["_x"].alias("t_left"), h["v"].alias("v_left"), h["x_next"].alias("t_right"), h["v_next"].alias("v_right"),
    )


def _split_for(waves, points, keys, x, rows_per_chunk) -> C.Chunks:
    """Cut by samples and points together, so neither overfills a piece."""
    axis = waves.select(*keys, F.col("t").alias("_axis"), F.col("i").cast("long").alias("_tie"))
    asked = points.select(*keys, F.col(x).cast("double").alias("_axis"), F.lit(None).cast("long").alias("_tie"))
    return C.plan_chunks(axis.unionByName(asked), keys, "_axis", "_tie", rows_per_chunk)


def value_at(
    waves: DataFrame, points: DataFrame, keys: Sequence[str] = S.KEYS, x: str = "x",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """As-of join with linear interpolation for a table of points ``(keys, x, …)``."""
    split = _split_for(waves, points, keys, x, rows_per_chunk)
    rows = C.neighbours(waves, keys, "t", "i", "v", split).drop(C.CHUNK)
    return read_at(rows, points, split, keys, x)


def nearest(
    waves: DataFrame, points: DataFrame, keys: Sequence[str] = S.KEYS, x: str = "x",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Value of the sample nearest to each point; of equals the first in order. A point of NULL reads NULL."""
    one = waves.groupBy(*keys, "t").agg(F.min(F.struct("i", "v")).alias("_f"))
    one = one.select(*keys, "t", F.col("_f.i").alias("i"), F.col("_f.v").alias("v"))
    split = _split_for(one, points, keys, x, rows_per_chunk)
    rows = C.neighbours(one, keys, "t", "i", "v", split).drop(C.CHUNK)
    hit = C.last_known(rows, points, keys, "t", "i", x, ["v", "x_next", "v_next"], split)
    h = F.col("_hit")
    closer = F.abs(F.col(x) - h["_x"]) <= F.abs(h["x_next"] - F.col(x))
    left = F.when(F.col(x).isNotNull(), h["x_next"].isNull() | closer)
    return hit.select(
        *[c for c in hit.columns if c != "_hit"],
        F.when(left, h["_x"]).when(~left, h["x_next"]).alias("t_near"),
        F.when(left, h["v"]).when(~left, h["v_next"]).alias("v"),
    )


def _gap(xs: Column, t: Column, most: int) -> Column:
    """How many of the sorted ``xs`` (at most ``most``) are not above ``t``: halving steps, no loop over the points."""
    steps = F.lit([1 << b for b in reversed(range(most.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(xs, at + step - 1) <= t, at + step).otherwise(at)
    )


def _around(waves: DataFrame, points: DataFrame, keys: Sequence[str], x: str, keep: int, ties: str) -> DataFrame | None:
    """The ``keep`` first and last samples between any two neighbouring points of a key; None if points are many.

    The points are copied to the tasks. Each task keeps those few samples of its own
    rows before anything moves, so the samples are neither shuffled nor sorted as a whole.
    Of samples at one instant the last in order comes last, or with ``ties="first"`` the first.
    """
    few = points.select(*keys, F.col(x).cast("double").alias("_p"))
    most = few.limit(BROADCAST_ROWS + 1).count()
    if most > BROADCAST_ROWS:
        return None
    # at most BROADCAST_ROWS points, so neither an array nor the copied table is larger
    asked = few.groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("_xs"))
    asked = F.broadcast(asked.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_xs"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & waves[k].eqNullSafe(asked[f"_k{n}"])
    own = [*keys, "t", "i", "v"]
    placed = waves.join(asked, same).select(*own, _gap(F.col("_xs"), F.col("t"), most).alias("_gap"))
    part = Window.partitionBy(*keys, "_gap")
    last = F.desc("i") if ties == "last" else F.asc("i")
    ends = [placed.withColumn("_r", F.row_number().over(part.orderBy(*o))).where(F.col("_r") <= keep) for o in (["t", "i"], [F.desc("t"), last])]
    return ends[0].unionByName(ends[1]).select(*own).distinct()


def value_at_few(waves: DataFrame, points: DataFrame, keys: Sequence[str] = S.KEYS, x: str = "x") -> DataFrame:
    """``value_at`` for few points on long waves: only samples next to a point move.

    Two samples at each end of a gap are enough for every segment that is read, those
    beyond the data included. Above ``BROADCAST_ROWS`` points it is ``value_at``.
    """
    near = _around(waves, points, keys, x, 2, "last")
    return value_at(waves if near is None else near, points, keys, x)


def nearest_few(waves: DataFrame, points: DataFrame, keys: Sequence[str] = S.KEYS, x: str = "x") -> DataFrame:
    """``nearest`` for few points on long waves, as ``value_at_few``."""
    near = _around(waves, points, keys, x, 1, "first")
    return nearest(waves if near is None else near, points, keys, x)


# ------------------------------------------------------------------ single measurements


def _one(waves, func, sig, **options) -> DataFrame:
    return measure(waves, [Spec(name=func, func=func, sig=sig, **options)])


def measure_integ(waves, sig, t_from=None, t_to=None):
    return _one(waves, "integ", sig, t_from=t_from, t_to=t_to)


def measure_avg(waves, sig, t_from=None, t_to=None):
    return _one(waves, "avg", sig, t_from=t_from, t_to=t_to)


def measure_rms(waves, sig, t_from=None, t_to=None):
    return _one(waves, "rms", sig, t_from=t_from, t_to=t_to)


def measure_max(waves, sig, t_from=None, t_to=None):
    return _one(waves, "max", sig, t_from=t_from, t_to=t_to)


def measure_min(waves, sig, t_from=None, t_to=None):
    return _one(waves, "min", sig, t_from=t_from, t_to=t_to)


def measure_pp(waves, sig, t_from=None, t_to=None):
    return _one(waves, "pp", sig, t_from=t_from, t_to=t_to)


def measure_final(waves, sig):
    return _one(waves, "final", sig)


def measure_at(waves, sig, at):
    return _one(waves, "nearest", sig, at=at)


def measure_deriv(waves, sig, at=None):
    return _one(waves, "deriv", sig, at=at)


def measure_when(waves, sig, level=None, other=None, edge="cross", nth=1, t_from=None, t_to=None):
    return _one(waves, "when", sig, level=level, other=other, edge=edge, nth=nth, t_from=t_from, t_to=t_to)


def measure_find_at(waves, sig, at):
    return _one(waves, "find", sig, at=at)


def measure_find_when(waves, sig, other, level, edge="cross", nth=1, t_from=None, t_to=None):
    return _one(waves, "find", sig, other=other, level=level, edge=edge, nth=nth, t_from=t_from, t_to=t_to)


def measure_delay(waves, trig: dict, targ: dict, t_from=None, t_to=None):
    """Each side is ``{"sig", "level", "edge", "nth"}``."""
    return _one(
        waves, "trig", trig["sig"], level=trig.get("level"), edge=trig.get("edge", "cross"), nth=trig.get("nth", 1),
        other=targ["sig"], level2=targ.get("level"), edge2=targ.get("edge", "cross"), nth2=targ.get("nth", 1),
        t_from=t_from, t_to=t_to,
    )


def window_of(
    waves: DataFrame, t_from: float | None = None, t_to: float | None = None, keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """The asked window clamped to the data of each key, or an error."""
    g = waves.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("tn"))
    lo = F.coalesce(F.lit(t_from).cast("double"), F.col("t0"))
    hi = F.coalesce(F.lit(t_to).cast("double"), F.col("tn"))
    good = (hi > lo) & (lo < F.col("tn")) & (hi > F.col("t0"))
    return g.select(
        *keys,
        F.when(good, F.greatest(lo, F.col("t0"))).alias("lo"),
        F.when(good, F.least(hi, F.col("tn"))).alias("hi"),
        F.when(~good, F.lit(NO_WINDOW)).alias("error"),
    )


def slew_rate(waves: DataFrame, keys: Sequence[str] = S.KEYS, rows_per_chunk: int | None = None) -> DataFrame:
    """Rise between 20 % and 80 % of the swing over the time between its first samples there.

    The 80 % sample is looked for after the 20 % sample.
    """
    rows, _ = S.samples(waves, keys, rows_per_chunk)
    swing = waves.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    r = rows.join(swing, list(keys))
    low = F.col("_lo") + 0.2 * (F.col("_hi") - F.col("_lo"))
    high = F.col("_lo") + 0.8 * (F.col("_hi") - F.col("_lo"))
    arrives = lambda level: (F.col("v") < level) & (F.col("v_next") >= level)
    here = F.struct(F.col("x_next").alias("t"), F.col("i"))
    start = r.where(arrives(low)).groupBy(*keys).agg(F.min(here).alias("_a"))
    rises = r.where(arrives(high)).select(*keys, here.alias("_b"), low.alias("_low"), high.alias("_high"))
    return (
        rises.join(start, list(keys))
        .where(F.col("_b") >= F.col("_a"))
        .groupBy(*keys)
        .agg(F.min("_b").alias("_b"), F.first("_a").alias("_a"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
        .select(
            *keys,
            F.col("_a.t").alias("t20"),
            F.col("_b.t").alias("t80"),
            F.try_divide(F.col("_high") - F.col("_low"), F.col("_b.t") - F.col("_a.t")).alias("slew"),
        )
    )
