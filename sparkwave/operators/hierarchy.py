"""Nested definitions: scoped lookup, port binding, expansion, inherited parameters.

``cards(deck, scope, line, letter, name, nodes, args, params)`` are the lines of
all bodies and ``defs(deck, scope, name, ports, defaults)`` the definitions;
``scope`` is the path of the body a row stands in, empty at the top, and the body
of ``name`` in scope ``s`` has the scope ``s/name`` in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.functions.names import is_ground
from sparkwave.functions.scalar import _c, bound, eng_parse_once
from sparkwave.operators.cases import override_map
from sparkwave.plans.lineage import cut

MAX_DEPTH = 64


def body_scope(scope, name) -> Column:
    return F.concat(_c(scope), F.lit("/"), F.lower(_c(name)))


def enclosing(scope) -> Column:
    """A scope and the scopes around it, innermost first, the top last."""
    parts = F.split(_c(scope), "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(parts, 1, n - k), "/"))


def scoped_lookup(refs: DataFrame, defs: DataFrame, chain: Column, keys: list[str]) -> DataFrame:
    """The definition each reference means: the innermost scope of ``chain`` that has it.

    ``keys`` identify a reference; ``refs`` has ``deck`` and ``ref``. References
    without a definition are left out (``undefined_refs`` lists them).
    """
    whole = F.struct(*[c for c in defs.columns if c != "deck"]).alias("definition")
    d = defs.select("deck", F.col("scope").alias("_scope"), F.lower("name").alias("_key"), whole)
    met = along(refs.withColumn("_key", F.lower("ref")), chain).join(d, ["deck", "_scope", "_key"])
    return met.groupBy(*keys).agg(F.min_by("definition", "_at").alias("definition"))


def along(refs: DataFrame, chain: Column) -> DataFrame:
    """A row per scope of the short ``chain``: ``_scope`` and its place ``_at``, so that scopes join as keys."""
    return refs.select("*", F.posexplode(chain).alias("_at", "_scope"))


def undefined_refs(refs: DataFrame, defs: DataFrame, on: str = "ref", name: str = "name", within: tuple[str, ...] = ("deck",)) -> DataFrame:
    """References whose name no definition has, without regard to case."""
    known = defs.select(*within, F.lower(name).alias("_key")).distinct()
    return refs.withColumn("_key", F.lower(on)).join(known, [*within, "_key"], "left_anti").drop("_key")


def bind_ports(instances: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ports of ``instances(keys, nodes, ports)`` with their nodes, and those whose counts differ."""
    equal = F.size("nodes") == F.size("ports")
    pair = F.arrays_zip(F.col("ports").alias("port"), F.col("nodes").alias("node"))
    good = instances.where(equal).select(*keys, F.posexplode(pair).alias("pos", "_p")).select(
        *keys, "pos", F.lower("_p.port").alias("port"), F.col("_p.node").alias("node")
    )
    bad = instances.where(~equal).select(
        *keys, F.concat(F.size("ports").cast("string"), F.lit(" nodes needed, "), F.size("nodes").cast("string"), F.lit(" given")).alias("error")
    )
    return good, bad


# ------------------------------------------------------------------ parameters


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^[{']|[}']$", ""))


def _read(text: Column, known: Column) -> Column:
    """A literal, or the value of the one parameter it names; NULL for anything else."""
    number = lambda t: F.when(F.rlike(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[A-Za-zµμ]*$")), eng_parse_once(t))
    return bound(_plain(text), lambda t: F.coalesce(number(t), F.try_element_at(known, F.lower(t))))


def resolve_map(raw: Column, base: Column) -> Column:
    """Values of a map whose entries may name each other or ``base``, in any order.

    As many passes as there are entries; what still has no value is left out.
    """
    one_pass = lambda known, _: override_map(
        known, F.map_filter(F.transform_values(raw, lambda k, v: _read(v, known)), lambda k, v: v.isNotNull())
    )
    passes = F.when(F.size(raw) > 0, F.sequence(F.lit(1), F.size(raw))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(passes, base.cast("map<string,double>"), one_pass)


def _given(texts: Column, known: Column) -> tuple[Column, Column]:
    """The entries of a map of texts that have a value, and the names of those that have none."""
    values = F.map_filter(F.transform_values(texts, lambda k, v: _read(v, known)), lambda k, v: v.isNotNull())
    return values, F.array_except(F.map_keys(texts), F.map_keys(values))


def _environment(defaults: Column, overrides: Column, caller: Column) -> Column:
    """``env``, what the body of an instance knows, and ``missing``, the names of parameters without a value."""
    # an overridden default is still read, but the override stands in its place
    def known(mine: Column, given: Column) -> Column:
        lacking = F.concat(*[F.array_except(F.map_keys(raw), F.map_keys(got)) for raw, got in ((defaults, mine), (overrides, given))])
        return F.struct(override_map(mine, given).alias("env"), F.array_sort(F.array_distinct(lacking)).alias("missing"))

    return bound(resolve_map(defaults, caller), lambda mine: bound(_given(overrides, caller)[0], lambda given: known(mine, given)))


def inherit_params(instances: DataFrame, keys: list[str]) -> DataFrame:
    """``params`` and ``leftovers`` of instances with ``defaults``, ``overrides`` and ``caller``.

    Defaults are read in the callee, overrides in the caller, and overrides win.
    """
    known = _environment(F.col("defaults"), F.col("overrides"), F.col("caller").cast("map<string,double>"))
    return instances.select(*keys, known.alias("_known")).select(
        *keys, F.col("_known.env").alias("params"), F.col("_known.missing").alias("leftovers")
    )


# ------------------------------------------------------------------ expansion


@dataclass
class Flat:
    """Expanded elements, the reasons why instances could not be expanded, and what the instances know.

    ``values`` and ``arg_values`` are the numbers of ``params`` and ``args``, literal or by the name of a
    parameter of the instance they stand in; ``leftovers`` names the ``params`` without one.
    """

    elements: DataFrame   # deck, name, letter, nodes, args, params, depth, line, scope, values, arg_values, leftovers
    errors: DataFrame     # deck, name, line, error
    instances: DataFrame  # deck, name, line, depth, params, leftovers


NO_MAP = "map<string,string>"


def expand_hierarchy(cards: DataFrame, defs: DataFrame, max_depth: int = MAX_DEPTH, globals: DataFrame | None = None) -> Flat:
    """Expand every instance (letter ``x``) of every deck, one level per round.

    Names are prefixed with the instance path, ports become the caller's nodes,
    ground stays ``0`` and inner nodes get the prefix. The first argument of an
    instance names its definition, looked up along the chain of callers. The
    elements and instances of a deck with an error are not returned.

    Parameters travel with the levels: an instance's body knows all that its caller
    knows, the definition's defaults and, in their place, the instance's ``params``
    read in the caller. ``globals(deck, params)`` are known at the top, in texts that
    may name each other.
    """
    empty, unknown = F.create_map().cast(NO_MAP), F.create_map().cast("map<string,double>")
    decks = cards.select("deck").distinct()
    if globals is not None:
        told = globals.select("deck", resolve_map(F.coalesce("params", empty), unknown).alias("env"))
        decks = decks.join(told, "deck", "left")
    front = cut(
        decks.select(
            F.coalesce("env", unknown).alias("env") if globals is not None else unknown.alias("env"),
            "deck", F.lit("").alias("prefix"), F.lit("").alias("body"), F.array(F.lit("")).alias("chain"),
            F.array().cast("array<string>").alias("seen"), empty.alias("ports"), F.lit(0).alias("depth"),
        )
    )
    known = defs.select(
        "deck", F.col("scope").alias("_scope"), F.lower("name").alias("_key"),
        F.struct("scope", "name", "ports", body_scope("scope", "name").alias("body"), F.coalesce("defaults", empty).alias("defaults")).alias("d"),
    )
    elements, errors, instances = [], [], []
    for depth in range(max_depth + 2):
        if front.limit(1).count() == 0:
            break
        if depth > max_depth:
            errors.append(front.select("deck", F.regexp_replace("prefix", r"\.$", "").alias("name"), F.lit(0).alias("line"), F.lit("nested too deep").alias("error")))
            break
        node = lambda n: F.when(is_ground(n), F.lit("0")).otherwise(
            F.coalesce(F.try_element_at("ports", F.lower(n)), F.concat("prefix", n))
        )
        here = front.drop("line", "leftovers").join(cards.withColumnRenamed("scope", "body"), ["deck", "body"]).select(
            "deck", "body", "chain", "seen", "prefix", "depth", "line", F.lower("letter").alias("letter"),
            F.concat("prefix", "name").alias("name"), F.transform("nodes", node).alias("nodes"), "args", "params", "env",
        )
        values, leftovers = _given(F.coalesce("params", empty), F.col("env"))
        linked = F.when(F.col("letter") == "k", 2).when(F.col("letter").isin("f", "h"), 1).otherwise(0)
        args = F.transform("args", lambda a, i: F.when(i < linked, F.concat(F.col("prefix"), a)).otherwise(a))
        elements.append(
            here.where(F.col("letter") != "x").select(
                "deck", "name", "letter", "nodes", args.alias("args"), "params", "depth", "line", F.col("body").alias("scope"),
                values.alias("values"), F.transform("args", lambda a: _read(a, F.col("env"))).alias("arg_values"), F.array_sort(leftovers).alias("leftovers"),
            )
        )
        calls = cut(here.where(F.col("letter") == "x").withColumn("ref", F.get("args", F.lit(0))))
        if calls.limit(1).count() == 0:
            front = calls.limit(0)
            break
        asked = calls.select("deck", "name", "line", "chain", F.lower("ref").alias("_key"))
        met = along(asked, F.col("chain")).join(known, ["deck", "_scope", "_key"])
        # later callers are nearer
        chosen = met.groupBy("deck", "name", "line").agg(F.max_by("d", "_at").alias("d"))
        resolved = cut(calls.join(chosen, ["deck", "name", "line"], "left"))
        # names depend on the callers by nearest occurrence alone, so meeting the
        # same sequence of them again means that the expansion never ends
        resolved = resolved.withColumn("chain", F.concat(F.array_remove("chain", F.col("d.body")), F.array("d.body")))
        state = F.array_join("chain", " ")
        wrong = (
            F.when(F.col("ref").isNull(), F.lit("no definition named"))
            .when(F.col("d").isNull(), F.concat(F.lit("undefined definition: "), F.col("ref")))
            .when(
                F.size("nodes") != F.size("d.ports"),
                F.concat(F.size("d.ports").cast("string"), F.lit(" nodes needed, "), F.size("nodes").cast("string"), F.lit(" given")),
            )
            .when(F.array_contains("seen", state), F.lit("nested too deep"))
        )
        errors.append(resolved.where(wrong.isNotNull()).select("deck", "name", "line", wrong.alias("error")))
        inside = _environment(F.col("d.defaults"), F.coalesce("params", empty), F.col("env"))
        front = cut(
            resolved.where(wrong.isNull()).withColumn("_known", inside).select(
                "deck",
                "line",
                F.col("_known.env").alias("env"),
                F.col("_known.missing").alias("leftovers"),
                F.concat("name", F.lit(".")).alias("prefix"),
                F.col("d.body").alias("body"),
                "chain",
                F.concat("seen", F.array(state)).alias("seen"),
                F.map_from_arrays(F.transform("d.ports", lambda p: F.lower(p)), "nodes").alias("ports"),
                (F.col("depth") + 1).alias("depth"),
            )
        )
        instances.append(front.select("deck", F.regexp_replace("prefix", r"\.$", "").alias("name"), "line", "depth", F.col("env").alias("params"), "leftovers"))
    if not instances:
        nothing = front.select("deck", F.col("prefix").alias("name"), F.lit(0).alias("line"), "depth", F.col("env").alias("params"), "seen")
        instances.append(nothing.withColumnRenamed("seen", "leftovers").limit(0))
    known_params = instances[0]
    for i in instances[1:]:
        known_params = known_params.unionByName(i)
    flat = elements[0]
    for e in elements[1:]:
        flat = flat.unionByName(e)
    if not errors:
        none = flat.select("deck", "name", "line", F.lit("").alias("error")).limit(0)
        return Flat(flat, none, known_params)
    bad = errors[0]
    for e in errors[1:]:
        bad = bad.unionByName(e)
    wrong_decks = bad.select("deck").distinct()
    return Flat(flat.join(wrong_decks, "deck", "left_anti"), bad, known_params.join(wrong_decks, "deck", "left_anti"))


def include_graph(edges: DataFrame, roots: DataFrame, max_depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """Files reached from each root by ``edges(path, target, line)``, and where nesting is too deep.

    Reached rows carry the least depth. A cycle shows as an error, not as an
    endless loop, because a pair already reached is not followed again; paths
    that come back to a file of their own chain are the errors.
    """
    # read in every round, so their texts are taken apart once
    edges = cut(edges)
    seen = cut(roots.select(F.col("path").alias("root"), F.col("path"), F.lit(0).alias("depth")).distinct())
    front, errors = seen, []
    for depth in range(1, max_depth + 2):
        step = front.join(edges, "path").select("root", F.col("target").alias("path"), F.lit(depth).alias("depth")).distinct()
        fresh = cut(step.join(seen.select("root", "path"), ["root", "path"], "left_anti"))
        if fresh.limit(1).count() == 0:
            break
        if depth > max_depth:
            errors.append(fresh.select("root", "path", F.lit("include nesting too deep").alias("error")))
            break
        # rounds stay tables of their own; none is written twice
        seen = seen.unionByName(fresh)
        front = fresh
    # a file that reaches itself is circular for every root that reaches it
    looped = _files_on_cycles(edges, max_depth)
    circular = seen.join(looped, "path").select("root", "path", F.lit("circular include").alias("error"))
    for e in errors:
        circular = circular.unionByName(e)
    return seen, circular


def _files_on_cycles(edges: DataFrame, max_depth: int) -> DataFrame:
    """Files left when those without an unfinished include are peeled off, both ways."""
    left = cut(edges.select("path", "target").where(F.col("path") != F.col("target")).distinct())
    own = edges.where(F.col("path") == F.col("target")).select("path").distinct()
    size = left.count()
    while size:
        kept = left.join(left.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
        kept = kept.join(kept.select(F.col("target").alias("path")).distinct(), "path", "left_semi")
        left = cut(kept.select("path", "target"))
        now = left.count()
        if now == size:
            break
        size = now
    return left.select("path").unionByName(own).distinct()
