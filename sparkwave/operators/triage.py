"""Verdicts over decks: which can be used, which are broken, which need more.

A verdict is ``yes``, ``unsupported`` (valid, not implemented), ``invalid`` or
``unresolved`` (a missing file). Only ``unsupported`` lets another consumer try.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwave.functions.scalar import bound, eng_parse
from sparkwave.operators import lines as L
from sparkwave.operators.catalog import match_blocks
from sparkwave.operators.hierarchy import along, enclosing, expand_hierarchy
from sparkwave.plans.lineage import cut

# Directives that are read or ignored, and their least token count.
LEAST_TOKENS = {
    ".param": 1, ".params": 1, ".model": 3, ".op": 1, ".tf": 3, ".dc": 5, ".ac": 5, ".tran": 3,
    ".options": 1, ".option": 1, ".subckt": 2, ".include": 2, ".inc": 2, ".lib": 2,
    ".ends": 1, ".eom": 1, ".end": 1, ".title": 1, ".probe": 1, ".print": 1, ".plot": 1, ".width": 1,
    ".temp": 1, ".nodeset": 1, ".ic": 1, ".save": 1, ".four": 1, ".fourier": 1, ".measure": 1, ".meas": 1, ".step": 1,
}
INCLUDES = (".include", ".inc", ".lib")
# Nodes of each element letter; q and m take a fourth when a model still follows.
NODES = {"r": 2, "c": 2, "l": 2, "d": 2, "v": 2, "i": 2, "k": 0, "f": 2, "h": 2, "e": 4, "g": 4, "s": 4}
LETTERS = "rclkviefghdqmsx"
BEHAVIOURAL = ("value", "table", "laplace", "freq", "poly")
# Model types each element reads, and parameters that must be numbers.
MODEL_TYPES = {"d": ("d",), "q": ("npn", "pnp"), "m": ("nmos", "pmos"), "s": ("sw",)}
RECOGNISED = {
    "d": (
        "is", "n", "rs", "cjo", "cj0", "vj", "m", "tt", "bv", "ibv", "eg", "xti", "fc", "kf", "af", "area",
    ),
    "q": (
        "is", "bf", "nf", "vaf", "va", "ikf", "ise", "ne", "br", "nr", "var", "vb", "ikr", "isc", "nc", "rb",
        "re", "rc", "cje", "vje", "mje", "cjc", "vjc", "mjc", "xcjc", "tf", "tr", "fc", "eg", "xti", "xtb",
        "area", "kf", "af",
    ),
    "m": (
        "nsub", "xj", "ld", "uo", "vmax", "theta", "eta", "kappa", "delta", "nfs", "level", "vto", "vt0",
        "kp", "gamma", "phi", "lambda", "rd", "rs", "is", "js", "cbd", "cbs", "pb", "cgso", "cgdo", "cgbo",
        "cj", "mj", "cjsw", "mjsw", "fc", "tox", "l", "w", "ad", "as", "pd", "ps", "nrd", "nrs", "rsh", "kf",
        "af",
    ),
}
LEVELS = (1.0, 3.0)
STATISTICAL = r"(?i)^\s*(agauss|gauss|aunif|unif|limit)"


def deck_cards(decks: DataFrame) -> DataFrame:
    """Cards of ``decks(deck, text)`` up to ``.end``, without the title line.

    Adds the tokens, the scope of the body each card stands in, and whether a
    ``.subckt`` is closed.
    """
    cards = L.logical_lines(decks, L.DECK_COMMENTS, ("deck",))
    some = lambda toks: F.when(F.size(toks) > 0, F.array(toks))
    # a filter on the tokens would take them apart a second time
    toks = cards.select("*", F.explode(bound(L.grouped_tokens("text"), some)).alias("toks"))
    along = Window.partitionBy("deck").orderBy("line")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    head = F.lower(F.get("toks", F.lit(0)))
    marked = toks.withColumn("head", head).select(
        "*",
        ((F.row_number().over(along) == 1) & ~F.startswith("head", F.lit("."))).alias("_title"),
        F.max((F.col("head") == ".end").cast("int")).over(upto).alias("_over"),
    )
    # the walk over the blocks reads its cards several times
    return _with_scope(cut(marked.where(~F.col("_title") & (F.col("_over") == 0)).drop("_title", "_over")))


def _with_scope(toks: DataFrame) -> DataFrame:
    """The path of open ``.subckt`` names at each card.

    The block around a card is the last opener of its own level, so each level of
    a deck is walked once; paths are then built from the outermost level inward.
    """
    delta = F.when(F.col("head") == ".subckt", 1).when(F.col("head").isin(".ends", ".eom"), -1).otherwise(0)
    walked = match_blocks(toks.withColumn("delta", delta).withColumn("end", F.col("line").cast("long")), ("deck",))
    opens = F.col("delta") > 0
    # open blocks around the card itself, not counting the one it opens
    level = F.col("depth") - F.when(opens, 1).otherwise(0) + F.when(F.col("delta") < 0, 1).otherwise(0)
    rows = walked.select("*", level.alias("_level"))
    asks = rows.select("deck", F.col("_level").alias("_l"), "line", F.lit(None).cast("int").alias("_opener"))
    gives = rows.where(opens).select("deck", F.col("depth").alias("_l"), "line", F.col("line").alias("_opener"))
    before = Window.partitionBy("deck", "_l").orderBy("line", F.col("_opener").isNotNull())
    around = (
        asks.unionByName(gives)
        .withColumn("_around", F.last("_opener", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_opener").isNull() & (F.col("_l") > 0))
        .select("deck", "line", "_around")
    )
    rows = rows.join(around, ["deck", "line"], "left")
    name = F.lower(F.coalesce(F.get("toks", F.lit(1)), F.lit("")))
    blocks = cut(rows.where(opens).select("deck", F.col("line").alias("_block"), "depth", "_around", name.alias("_name")))
    deepest = blocks.agg(F.max("depth")).first()[0] or 0
    paths = blocks.where(F.col("depth") == 1).select("deck", "_block", F.concat(F.lit("/"), "_name").alias("_path"))
    last = paths
    for depth in range(2, deepest + 1):
        outer = last.select("deck", F.col("_block").alias("_around"), F.col("_path").alias("_outer"))
        last = blocks.where(F.col("depth") == depth).join(outer, ["deck", "_around"]).select(
            "deck", "_block", F.concat("_outer", F.lit("/"), "_name").alias("_path")
        )
        paths = paths.unionByName(last)
    return rows.join(paths.withColumnRenamed("_block", "_around"), ["deck", "_around"], "left").select(
        "deck", "line", "text", "toks", "head", F.coalesce("_path", F.lit("")).alias("scope"),
        F.when(opens, F.col("close_line").isNotNull()).alias("closed"),
    )


def _node_count(letter: Column, n_positional: Column) -> Column:
    out = F.lit(2)
    for name, count in NODES.items():
        out = F.when(letter == name, F.lit(count)).otherwise(out)
    out = F.when(letter.isin("q", "m"), F.when(n_positional >= 5, 4).otherwise(3)).otherwise(out)
    return F.when(letter == "x", F.greatest(n_positional - 1, F.lit(0))).otherwise(out)


def elements(cards: DataFrame) -> DataFrame:
    """Element cards split into nodes, arguments and parameters."""
    letter = F.substring("head", 1, 1)
    pos = F.slice("toks", 2, F.size("toks"))
    rows = cards.where(~F.startswith("head", F.lit("."))).select(
        "deck", "scope", "line", letter.alias("letter"), F.get("toks", F.lit(0)).alias("name"),
        L.positional(pos).alias("_pos"), L.params_kv(pos).alias("params"), "toks",
    )
    rows = rows.withColumn("n_nodes", _node_count(F.col("letter"), F.size("_pos")))
    return rows.select(
        "deck", "scope", "line", "letter", "name", F.slice("_pos", 1, F.col("n_nodes")).alias("nodes"),
        F.slice("_pos", F.col("n_nodes") + 1, F.greatest(F.size("_pos"), F.lit(1))).alias("args"), "params", "toks",
        "n_nodes", F.size("_pos").alias("n_pos"),
    )


def definitions(cards: DataFrame) -> DataFrame:
    """``defs`` of the hierarchy operators, from ``.subckt`` cards."""
    rest = F.slice("toks", 3, F.size("toks"))
    return cards.where((F.col("head") == ".subckt") & F.col("closed")).select(
        "deck", "scope", F.get("toks", F.lit(1)).alias("name"), L.positional(rest).alias("ports"), L.params_kv(rest).alias("defaults")
    )


def models(cards: DataFrame) -> DataFrame:
    """``.model`` cards: name, type in lower case, parameters."""
    tail = F.array_join(F.slice("toks", 3, F.size("toks")), " ")
    return cards.where((F.col("head") == ".model") & (F.size("toks") >= 3)).select(
        "deck", "scope", "line", F.get("toks", F.lit(1)).alias("name"),
        F.lower(F.substring_index(F.get("toks", F.lit(2)), "(", 1)).alias("type"),
        L.card_params(tail).alias("params"),
    )


def check_params(used: DataFrame) -> DataFrame:
    """Model parameters that a device reads but that are no number.

    ``used(deck, line, letter, params)``; metadata is ignored, statistical forms
    are unsupported, a plain literal passes, other expressions are ``unchecked``.
    """
    wanted = F.lit(None).cast("array<string>")
    for letter, names in RECOGNISED.items():
        wanted = F.when(F.col("letter") == letter, F.array(*[F.lit(n) for n in names])).otherwise(wanted)
    rows = used.select("deck", "line", "letter", F.explode("params").alias("key", "value"), wanted.alias("_w"))
    rows = rows.where(F.array_contains("_w", F.col("key")) & eng_parse("value").isNull())
    expression = F.rlike("value", F.lit(r"^\s*[{']"))
    kind = (
        F.when(F.rlike("value", F.lit(STATISTICAL)), F.lit("unsupported"))
        .when(expression, F.lit("unchecked"))
        .otherwise(F.lit("invalid"))
    )
    return rows.select("deck", "line", "letter", "key", "value", kind.alias("kind"))


def _finding(df: DataFrame, stage: int, kind, message: Column) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("deck", F.lit(stage).alias("stage"), F.col("line").cast("int").alias("line"), k.alias("kind"), message.alias("message"))


def triage(decks: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """``(deck, kind, line, message)``: the first finding of each deck, else ``yes``.

    ``available(path)`` are the files an include may name. Reading problems come
    before lookup problems, and those before model problems.
    """
    # read a dozen times below
    cards = cut(deck_cards(decks))
    n = F.size("toks")
    found = []

    dots = cards.where(F.startswith("head", F.lit(".")))
    known = F.col("head").isin(*LEAST_TOKENS)
    found.append(_finding(dots.where(~known), 1, "unsupported", F.concat(F.lit("unsupported directive "), F.col("head"))))
    least = F.lit(1)
    for name, count in LEAST_TOKENS.items():
        least = F.when(F.col("head") == name, F.lit(count)).otherwise(least)
    table = (F.col("head") == ".ac") & F.exists("toks", lambda t: F.rlike(t, F.lit("(?i)^data=.")))
    found.append(_finding(dots.where(table), 1, "unsupported", F.lit("a DATA table is not implemented")))
    found.append(_finding(dots.where(known & (n < least) & ~table), 1, "invalid", F.concat("head", F.lit(" is too short"))))
    found.append(_finding(dots.where((F.col("head") == ".subckt") & ~F.coalesce("closed", F.lit(False))), 1, "invalid", F.lit("block is not closed")))
    includes = dots.where(F.col("head").isin(*INCLUDES) & (n >= 2)).withColumn("path", F.regexp_replace(F.get("toks", F.lit(1)), "^[\"']+|[\"']+$", ""))
    if available is not None:
        includes = includes.join(available.select("path").distinct(), "path", "left_anti")
    found.append(_finding(includes, 1, "unresolved", F.concat(F.lit("missing file "), F.col("path"))))

    els = cut(elements(cards))
    supported = F.contains(F.lit(LETTERS), F.col("letter"))
    short = F.col("n_pos") < F.col("n_nodes")
    words = F.transform("toks", lambda t: F.lower(F.substring_index(t, "=", 1)))
    formula = F.col("letter").isin("e", "g") & F.arrays_overlap(words, F.array(*[F.lit(b) for b in BEHAVIOURAL]))
    found.append(_finding(els.where(~supported), 1, "unsupported", F.concat(F.lit("unsupported element "), F.upper("letter"))))
    found.append(_finding(els.where(supported & short & formula), 1, "unsupported", F.concat("name", F.lit(": behavioural source"))))
    found.append(
        _finding(
            els.where(supported & short & ~formula), 1, "invalid",
            F.concat("name", F.lit(" needs "), F.col("n_nodes").cast("string"), F.lit(" nodes, has "), F.col("n_pos").cast("string")),
        )
    )

    usable = els.where(supported & ~short)
    # only decks with instances have anything to expand
    nested = usable.where(F.lower("letter") == "x").select("deck").distinct()
    flat = expand_hierarchy(usable.join(nested, "deck", "left_semi"), definitions(cards))
    found.append(_finding(flat.errors, 2, "invalid", F.concat("name", F.lit(": "), F.col("error"))))
    mods = models(cards)
    users = usable.where(F.col("letter").isin(*MODEL_TYPES)).withColumn("ref", F.get("args", F.lit(0)))
    found.append(_finding(users.where(F.col("ref").isNull()), 2, "invalid", F.concat("name", F.lit(": no model named"))))
    named = users.where(F.col("ref").isNotNull()).withColumn("_key", F.lower("ref"))
    m = mods.select("deck", F.col("scope").alias("_scope"), F.lower("name").alias("_key"), F.struct("scope", "line", "name", "type", "params").alias("m"))
    met = along(named, enclosing("scope")).join(m, ["deck", "_scope", "_key"])
    # of equal names in one scope the later card counts
    chosen = met.groupBy("deck", "line", "letter", "name").agg(F.min_by("m", F.struct("_at", -F.col("m.line"))).alias("m"))
    lost = named.join(chosen.select("deck", "line"), ["deck", "line"], "left_anti")
    found.append(_finding(lost, 2, "invalid", F.concat("name", F.lit(": undefined model "), F.col("ref"))))

    types = F.array().cast("array<string>")
    for letter, kinds in MODEL_TYPES.items():
        types = F.when(F.col("letter") == letter, F.array(*[F.lit(k) for k in kinds])).otherwise(types)
    right = F.array_contains(types, F.col("m.type"))
    found.append(_finding(chosen.where(~right), 3, "unsupported", F.concat("name", F.lit(": model type "), F.upper("m.type"))))
    read = check_params(chosen.where(right).select("deck", "line", "letter", F.col("m.params").alias("params")))
    found.append(_finding(read.where(F.col("kind") != "unchecked"), 3, F.col("kind"), F.concat(F.lit("parameter "), F.col("key"), F.lit(" cannot be read"))))
    level = F.coalesce(eng_parse(F.try_element_at("m.params", F.lit("level"))), F.lit(1.0))
    found.append(_finding(chosen.where(right & (F.col("letter") == "m") & ~level.isin(*LEVELS)), 3, "unsupported", F.concat("name", F.lit(": model level"))))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = every.groupBy("deck").agg(F.min_by(F.struct("kind", "line", "message"), F.struct("stage", "line", "kind")).alias("v"))
    unchecked = read.where(F.col("kind") == "unchecked").groupBy("deck").agg(F.count(F.lit(1)).alias("unchecked"))
    return (
        decks.select("deck").join(first, "deck", "left").join(unchecked, "deck", "left")
        .select("deck", F.coalesce("v.kind", F.lit("yes")).alias("kind"), "v.line", "v.message", F.coalesce("unchecked", F.lit(0).cast("long")).alias("unchecked"))
    )


def include_edges(decks: DataFrame) -> DataFrame:
    """``(path, target, line)`` of every include of ``decks(deck, text)``."""
    cards = L.logical_lines(decks, L.DECK_COMMENTS, ("deck",))
    named = lambda toks: F.when(F.lower(F.get(toks, F.lit(0))).isin(*INCLUDES), F.slice(toks, 2, 1))
    # a filter on the tokens would take them apart a second time
    rows = cards.select("deck", "line", F.explode(bound(L.grouped_tokens("text"), named)).alias("target"))
    return rows.select(F.col("deck").alias("path"), F.regexp_replace("target", "^[\"']+|[\"']+$", "").alias("target"), "line")


# ------------------------------------------------------------------ over many verdicts


def verdict_summary(verdicts: DataFrame, gates: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Counts by kind per corpus; ``gates`` gives the least ``yes`` and the most ``invalid``."""
    kinds = ("yes", "unsupported", "unresolved", "invalid")
    out = verdicts.groupBy("corpus").agg(F.count(F.lit(1)).alias("decks"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    if not gates:
        return out
    floor, budget = F.lit(None).cast("long"), F.lit(None).cast("long")
    for corpus, (least, most) in gates.items():
        floor = F.when(F.col("corpus") == corpus, F.lit(least)).otherwise(floor)
        budget = F.when(F.col("corpus") == corpus, F.lit(most)).otherwise(budget)
    return out.select("*", (F.col("yes") >= floor).alias("enough_yes"), (F.col("invalid") <= budget).alias("few_invalid"))


def cause_histogram(verdicts: DataFrame, top: int = 6) -> DataFrame:
    """The commonest causes of ``invalid``, names and numbers blanked, 64 characters."""
    blank = F.regexp_replace(F.regexp_replace("message", r"'[^']*'", "'X'"), r"\b\d+\b", "N")
    bad = verdicts.where((F.col("kind") == "invalid") & F.col("message").isNotNull())
    counted = bad.groupBy(F.substring(blank, 1, 64).alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "cause").limit(top)


def route_by_preference(verdicts: DataFrame) -> DataFrame:
    """First consumer that may take each deck, from ``verdicts(deck, pref, consumer, kind, message)``.

    The first verdict that is not ``unsupported`` decides: ``yes`` chooses its
    consumer, anything else stops the search. ``rejected`` counts those asked in
    vain and ``first_message`` is what the first of them said.
    """
    row = F.struct("pref", "consumer", "kind", "message")
    decided = F.when(F.col("kind") != "unsupported", row)
    g = verdicts.groupBy("deck").agg(F.min(decided).alias("d"), F.min(row).alias("f"), F.count(F.lit(1)).alias("n"))
    before = verdicts.join(g.select("deck", F.col("d.pref").alias("_stop")), "deck").groupBy("deck").agg(
        F.count_if(F.col("_stop").isNull() | (F.col("pref") < F.col("_stop"))).alias("passed")
    )
    final = F.coalesce("d", "f")
    chosen = F.col("d.kind") == "yes"
    stopped = F.col("d").isNotNull() & ~chosen
    return g.join(before, "deck").select(
        "deck",
        F.when(chosen, F.col("d.consumer")).alias("consumer"),
        final["kind"].alias("kind"),
        final["message"].alias("message"),
        (F.col("passed") + F.when(stopped, 1).otherwise(0)).alias("rejected"),
        F.when(F.col("passed") > 0, F.col("f.message")).alias("first_message"),
    )


def rejected_before(verdicts: DataFrame, routed: DataFrame) -> DataFrame:
    """The verdicts of the consumers that were asked and did not take the deck."""
    stop = verdicts.where(F.col("kind") != "unsupported").groupBy("deck").agg(F.min("pref").alias("_stop"))
    asked = verdicts.join(stop, "deck", "left").where(F.col("_stop").isNull() | (F.col("pref") <= F.col("_stop")))
    return asked.where(F.col("kind") != "yes").join(routed.select("deck"), "deck", "left_semi").drop("_stop")
