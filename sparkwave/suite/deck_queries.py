"""Hierarchies from region, nation and supplier; decks and verdicts from part and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.operators import hierarchy as H
from sparkwave.operators import triage as T
from sparkwave.suite.registry import query, spread, table

# ------------------------------------------------------------------ hierarchy


def hierarchy(spark, sf):
    """A deck per region; nations are instances of a definition each, suppliers their elements."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    none = F.create_map().cast("map<string,string>")
    top = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("deck"), F.lit("").alias("scope"), F.col("n_nationkey").cast("int").alias("line"), F.lit("x").alias("letter"),
        F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("name"), F.array(F.lit("in"), F.lit("GND")).alias("nodes"),
        F.array(F.upper("n_name")).alias("args"), none.alias("params"),
    )
    inner = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    body = F.concat(F.lit("/"), F.lower("n_name"))
    key = F.col("s_suppkey").cast("string")
    parts = inner.select(
        F.col("r_name").alias("deck"), body.alias("scope"), F.col("s_suppkey").cast("int").alias("line"), F.lit("r").alias("letter"),
        F.concat(F.lit("R"), key).alias("name"), F.array(F.lit("A"), F.concat(F.lit("m"), key)).alias("nodes"), F.array(F.lit("1k")).alias("args"), none.alias("params"),
    )
    links = inner.select(
        F.col("r_name").alias("deck"), body.alias("scope"), F.col("s_suppkey").cast("int").alias("line"), F.lit("f").alias("letter"),
        F.concat(F.lit("F"), key).alias("name"), F.array(F.lit("b"), F.lit("ground")).alias("nodes"), F.array(F.concat(F.lit("V"), key), F.lit("2")).alias("args"), none.alias("params"),
    )
    deep = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("deck"), body.alias("scope"), F.lit(0).alias("line"), F.lit("x").alias("letter"), F.lit("XC").alias("name"),
        F.array(F.lit("b")).alias("nodes"), F.array(F.lit("cell")).alias("args"), none.alias("params"),
    )
    cell = r.select(
        F.col("r_name").alias("deck"), F.lit("/cell").alias("scope"), F.lit(1).alias("line"), F.lit("c").alias("letter"), F.lit("C1").alias("name"),
        F.array(F.lit("p"), F.lit("q")).alias("nodes"), F.array(F.lit("1u")).alias("args"), none.alias("params"),
    )
    cards = top.unionByName(parts).unionByName(links).unionByName(deep).unionByName(cell)
    defs = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("deck"), F.lit("").alias("scope"), F.lower("n_name").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("ports"), none.alias("defaults")
    )
    cells = r.select(F.col("r_name").alias("deck"), F.lit("").alias("scope"), F.lit("CELL").alias("name"), F.array(F.lit("P")).alias("ports"), none.alias("defaults"))
    return cards, defs.unionByName(cells)


FLAT = """
WITH i AS (SELECT r_name AS deck, 'X' || n_nationkey || '.' AS prefix, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


@query(
    "join9_expand_hierarchy",
    FLAT + """SELECT deck, prefix || 'R' || s_suppkey AS name, 'r' AS letter, 'in ' || prefix || 'm' || s_suppkey AS nodes, '1k' AS args, CAST(1 AS INTEGER) AS depth FROM i JOIN supplier ON s_nationkey = n_nationkey
    UNION ALL SELECT deck, prefix || 'F' || s_suppkey, 'f', '0 0', prefix || 'V' || s_suppkey || ' 2', 1 FROM i JOIN supplier ON s_nationkey = n_nationkey
    UNION ALL SELECT deck, prefix || 'XC.C1', 'c', '0 ' || prefix || 'XC.q', '1u', 2 FROM i""",
)
def join9(spark, sf):
    flat = H.expand_hierarchy(*hierarchy(spark, sf))
    return flat.elements.select("deck", "name", "letter", F.array_join("nodes", " ").alias("nodes"), F.array_join("args", " ").alias("args"), "depth")


@query(
    "join5_scoped_lookup",
    """SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN '/n' || s_nationkey ELSE '' END AS found FROM supplier""",
)
def join5(spark, sf):
    """Every supplier refers to ``amp``; even nations define it themselves, odd ones use the outer one."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    here = F.concat(F.lit("/n"), F.col("s_nationkey").cast("string"))
    refs = s.select(F.lit("d").alias("deck"), "s_suppkey", F.lit("AMP").alias("ref"), F.concat(here, F.lit("/inner")).alias("scope"))
    own = n.where(F.col("n_nationkey") % 2 == 0).select(F.lit("d").alias("deck"), F.concat(F.lit("/n"), F.col("n_nationkey").cast("string")).alias("scope"), F.lit("amp").alias("name"))
    outer = table(spark, sf, "region").select(F.lit("d").alias("deck"), F.lit("").alias("scope"), F.lit("Amp").alias("name")).distinct()
    got = H.scoped_lookup(refs, own.unionByName(outer), H.enclosing("scope"), ["s_suppkey"])
    return got.select("s_suppkey", F.col("definition.scope").alias("found"))


@query("join6_undefined_refs", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def join6(spark, sf):
    name = lambda c: F.concat(F.lit("Model"), F.col(c).cast("string"))
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.lit("d").alias("deck"), F.upper(name("l_partkey")).alias("ref"))
    known = table(spark, sf, "part").where(F.col("p_size") <= 40).select(F.lit("d").alias("deck"), name("p_partkey").alias("name"))
    return H.undefined_refs(refs, known).select("l_orderkey", "l_partkey")


def _instances(spark, sf):
    o = table(spark, sf, "orders")
    nodes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 3), lambda k: F.concat(F.lit("n"), (F.col("o_orderkey") + k).cast("string")))
    return o.select("o_orderkey", nodes.alias("nodes"), F.array(F.lit("P"), F.lit("Q")).alias("ports"))


@query(
    "join8_bind_ports",
    "SELECT o_orderkey, CAST(k AS INTEGER) AS pos, CASE k WHEN 0 THEN 'p' ELSE 'q' END AS port, 'n' || (o_orderkey + k) AS node FROM orders, (SELECT unnest([0, 1]) AS k) WHERE o_custkey % 3 = 1",
)
def join8(spark, sf):
    return H.bind_ports(_instances(spark, sf), ["o_orderkey"])[0]


@query("join8_bind_ports_refused", "SELECT o_orderkey, '2 nodes needed, ' || (o_custkey % 3 + 1) || ' given' AS error FROM orders WHERE o_custkey % 3 <> 1")
def join8_refused(spark, sf):
    return H.bind_ports(_instances(spark, sf), ["o_orderkey"])[1]


@query(
    "join10_inherit_params",
    """SELECT p_partkey, p_size * 1000.0 AS r, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size * 1000.0 END AS top, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size * 1000.0 END AS given,
       'hard' AS leftovers FROM part""",
)
def join10(spark, sf):
    """``top`` names ``r``, even parts override it from the caller; ``hard`` is an expression."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))
    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    none = F.create_map().cast("map<string,string>")
    i = p.select(
        "p_partkey",
        m("top", "{mid}", "mid", "R", "r", F.concat(F.col("p_size").cast("string"), F.lit("k")), "hard", "{r*2}").alias("defaults"),
        F.when(F.col("p_size") % 2 == 0, m("top", "{price}")).otherwise(none).alias("overrides"),
        F.create_map(F.lit("price"), F.col("p_retailprice")).alias("caller"),
    )
    got = H.inherit_params(i, ["p_partkey"])
    top = F.col("params")["top"]
    return got.select("p_partkey", F.col("params")["r"].alias("r"), top.alias("top"), top.alias("given"), F.array_join("leftovers", " ").alias("leftovers"))


def parameter_chain(spark, sf):
    """A deck per region; every supplier is an instance of ``outer``, which holds one of ``mid``, which holds one of ``inner``.

    The parameter has another name on each level, and odd suppliers do not override it at the top.
    """
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]).cast("map<string,string>")
    key = F.col("s_suppkey").cast("string")
    of = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    top = of.select(
        F.col("r_name").alias("deck"), F.lit("").alias("scope"), F.col("s_suppkey").cast("int").alias("line"), F.lit("x").alias("letter"),
        F.concat(F.lit("X"), key).alias("name"), F.array(F.lit("in")).alias("nodes"), F.array(F.lit("outer")).alias("args"),
        F.when(F.col("s_suppkey") % 2 == 0, m("gain", F.concat(key, F.lit("k")))).otherwise(m()).alias("params"),
    )
    cards, defs = [top], []
    bodies = (
        ("outer", m("gain", "3", "bias", "{volt}"), "x", "XM", ("mid",), m("level", "{gain}")),
        ("mid", m("twice", "level", "level", "5"), "x", "XI", ("inner",), m("rv", "{level}", "cap", "{twice}", "off", "{1*2}")),
        ("inner", m("rv", "1k", "cap", "RV"), "r", "R1", ("{rv}", "{cap}"), m("tc", "{bias}", "bad", "{rv*2}")),
    )
    for name, defaults, letter, held, args, params in bodies:
        deck = F.col("r_name").alias("deck")
        defs.append(r.select(deck, F.lit("").alias("scope"), F.lit(name).alias("name"), F.array(F.lit("a")).alias("ports"), defaults.alias("defaults")))
        cards.append(
            r.select(
                deck, F.lit(f"/{name}").alias("scope"), F.lit(1).alias("line"), F.lit(letter).alias("letter"), F.lit(held).alias("name"),
                F.array(F.lit("a")).alias("nodes"), F.array(*map(F.lit, args)).alias("args"), params.alias("params"),
            )
        )
    told = r.select(F.col("r_name").alias("deck"), m("volt", F.col("r_regionkey").cast("string")).alias("params"))
    return H.expand_hierarchy(reduce(DataFrame.unionByName, cards), reduce(DataFrame.unionByName, defs), globals=told)


CHAIN = """
WITH i AS (SELECT r_name AS deck, r_regionkey::DOUBLE AS volt, 'X' || s_suppkey AS top, CASE WHEN s_suppkey % 2 = 0 THEN 1000.0 * s_suppkey ELSE 3.0 END AS gain
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(
    "join10_hierarchy_params",
    CHAIN + "SELECT deck, top || '.XM.XI.R1' AS name, gain::DOUBLE AS r, 5.0::DOUBLE AS cap, volt AS tc, 'bad' AS leftovers FROM i",
)
def join10_chain(spark, sf):
    """Elements: a default that names another one is read before the override takes its place, so ``cap`` stays 5."""
    e = parameter_chain(spark, sf).elements
    return e.select(
        "deck", "name", F.get("arg_values", F.lit(0)).alias("r"), F.get("arg_values", F.lit(1)).alias("cap"),
        F.try_element_at("values", F.lit("tc")).alias("tc"), F.array_join("leftovers", " ").alias("leftovers"),
    )


@query(
    "join10_instance_params",
    CHAIN + """SELECT deck, top AS name, 1 AS depth, gain::DOUBLE AS gain, NULL::DOUBLE AS level, NULL::DOUBLE AS rv, '' AS leftovers FROM i
    UNION ALL SELECT deck, top || '.XM', 2, gain, gain, NULL, '' FROM i
    UNION ALL SELECT deck, top || '.XM.XI', 3, gain, gain, gain, 'off' FROM i""",
)
def join10_instances(spark, sf):
    got = parameter_chain(spark, sf).instances
    value = lambda name: F.try_element_at("params", F.lit(name)).alias(name)
    return got.select("deck", "name", "depth", value("gain"), value("level"), value("rv"), F.array_join("leftovers", " ").alias("leftovers"))


# ------------------------------------------------------------------ decks

# body, verdict and line of each form of deck
FORMS = (
    ("R1 a b {size}\n.model DX D(is={size}e-14)\nD1 a b DX\n.tran 1u 1m\n.end\nnot read", "yes", None),
    ("* note\nR1 a\nQ", "invalid", 3),
    ("E1 a b\n+ VALUE={{V(1)*{size}}}", "unsupported", 2),
    (".include lib{size}.txt", "unresolved", 2),
    ("D1 a b NOPE", "invalid", 2),
    (".subckt blk a b\nR1 a b 1\n.ends\nX1 p q blk\nX2 p blk", "invalid", 6),
    (".subckt open a b\nR1 a b 1", "invalid", 2),
    ("M1 d g s b MM\n.model MM NMOS level={size}0", "unsupported", 2),
    ("D1 a b DS\n.model DS D is=agauss(1,2,{size})", "unsupported", 2),
    ("D1 a b DB\n.model DB D is=foo mfg=X{size}", "invalid", 2),
    (".noise v(out)", "unsupported", 2),
)


def decks(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"))
    form = F.col("p_partkey") % len(FORMS)
    body = F.lit("")
    for n, (text, _, _) in enumerate(FORMS):
        pieces = text.split("{size}")
        parts = []
        for j, piece in enumerate(pieces):
            parts += [F.lit(piece.replace("{{", "{").replace("}}", "}"))] + ([F.col("p_size").cast("string")] if j < len(pieces) - 1 else [])
        body = F.when(form == n, F.concat(*parts)).otherwise(body)
    return p.select(F.col("p_partkey").cast("string").alias("deck"), F.concat(F.lit("a title\n"), body).alias("text"))


KIND_LIST = ", ".join(f"'{k}'" for _, k, _ in FORMS)
LINE_LIST = ", ".join("NULL" if n is None else str(n) for _, _, n in FORMS)
PICK = f"list_extract([{{0}}], CAST(p_partkey % {len(FORMS)} AS INTEGER) + 1)"


@query(
    "cat14_triage",
    f"SELECT CAST(p_partkey AS VARCHAR) AS deck, {PICK.format(KIND_LIST)} AS kind, CAST({PICK.format(LINE_LIST)} AS INTEGER) AS line FROM part",
)
def cat14(spark, sf):
    return T.triage(decks(spark, sf)).select("deck", "kind", "line")


@query(
    "cat15_check_params",
    """SELECT p_partkey AS deck, 'is' AS key, CASE WHEN p_size % 3 = 0 THEN 'unsupported' WHEN p_size % 3 = 1 THEN 'unchecked' ELSE 'invalid' END AS kind FROM part""",
)
def cat15(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_size") % 3
    value = F.when(k == 0, "AGAUSS(1,2,3)").when(k == 1, "{2*x}").otherwise("typo")
    used = p.select(
        F.col("p_partkey").alias("deck"), F.lit(1).alias("line"), F.lit("d").alias("letter"),
        F.create_map(F.lit("is"), value, F.lit("n"), F.lit("1.5"), F.lit("mfg"), F.col("p_brand")).alias("params"),
    )
    return T.check_params(used).select("deck", "key", "kind")


@query(
    "cat16_include_graph",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS b FROM part WHERE p_partkey % 10 > 0),
    r AS (SELECT p_partkey AS root, p_partkey AS path, 0 AS depth FROM part WHERE p_partkey % 10 = 9 UNION ALL SELECT root, e.b, depth + 1 FROM r JOIN e ON e.a = r.path)
    SELECT CAST(root AS VARCHAR) AS root, CAST(path AS VARCHAR) AS path, CAST(depth AS INTEGER) AS depth FROM r""",
)
def cat16(spark, sf):
    """Parts include the part before them, ten to a chain."""
    p = spread(table(spark, sf, "part").select("p_partkey"))
    text = F.concat(F.lit("title\n.include '"), (F.col("p_partkey") - 1).cast("string"), F.lit("'\n.end"))
    files = p.where(F.col("p_partkey") % 10 > 0).select(F.col("p_partkey").cast("string").alias("deck"), text.alias("text"))
    roots = p.where(F.col("p_partkey") % 10 == 9).select(F.col("p_partkey").cast("string").alias("path"))
    return H.include_graph(T.include_edges(files), roots)[0]


@query(
    "cat16_include_errors",
    """SELECT CAST(p_partkey AS VARCHAR) AS root, CAST(p_partkey - k AS VARCHAR) AS path, 'circular include' AS error
    FROM part, range(0, 10) r(k) WHERE p_partkey % 10 = 9 AND p_partkey // 10 % 3 = 1""",
)
def cat16_errors(spark, sf):
    """In every third chain the first part includes the last one again."""
    p = spread(table(spark, sf, "part").select("p_partkey"))
    again = (F.col("p_partkey") % 10 == 0) & (F.floor(F.col("p_partkey") / 10) % 3 == 1)
    target = F.when(again, F.col("p_partkey") + 9).otherwise(F.col("p_partkey") - 1).cast("string")
    text = F.concat(F.lit("title\n.include '"), target, F.lit("'\n.end"))
    files = p.where((F.col("p_partkey") % 10 > 0) | again).select(F.col("p_partkey").cast("string").alias("deck"), text.alias("text"))
    roots = p.where(F.col("p_partkey") % 10 == 9).select(F.col("p_partkey").cast("string").alias("path"))
    return H.include_graph(T.include_edges(files), roots)[1]


# ------------------------------------------------------------------ verdict tables


def verdicts(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.get(F.array(*[F.lit(k) for k in ("yes", "unsupported", "unresolved", "invalid")]), (F.col("o_custkey") % 4).cast("int"))
    return o.select(
        F.col("o_orderpriority").alias("corpus"), F.col("o_orderkey").cast("string").alias("deck"), kind.alias("kind"),
        F.concat(F.lit("R"), (F.col("o_custkey") % 7).cast("string"), F.lit(": model '"), F.col("o_orderstatus"), F.lit("' needs "), (F.col("o_custkey") % 5).cast("string"), F.lit(" nodes at "), F.col("o_orderstatus")).alias("message"),
    )


@query(
    "agg18_verdict_summary",
    """SELECT o_orderpriority AS corpus, count(*) AS decks, count(*) FILTER (o_custkey % 4 = 0) AS yes, count(*) FILTER (o_custkey % 4 = 1) AS unsupported,
       count(*) FILTER (o_custkey % 4 = 2) AS unresolved, count(*) FILTER (o_custkey % 4 = 3) AS invalid,
       CASE WHEN o_orderpriority = '5-LOW' THEN count(*) FILTER (o_custkey % 4 = 0) >= 20 END AS enough_yes, CASE WHEN o_orderpriority = '5-LOW' THEN count(*) FILTER (o_custkey % 4 = 3) <= 185 END AS few_invalid FROM orders GROUP BY o_orderpriority""",
)
def agg18(spark, sf):
    return T.verdict_summary(verdicts(spark, sf), {"5-LOW": (20, 185)})


@query(
    "agg19_top3_cause_histogram",
    """WITH v AS (SELECT substr('R' || o_custkey % 7 || ': model ''X'' needs N nodes at ' || o_orderstatus, 1, 64) AS cause FROM orders WHERE o_custkey % 4 = 3)
    SELECT cause, count(*) AS n FROM v GROUP BY cause ORDER BY n DESC, cause LIMIT 6""",
)
def agg19(spark, sf):
    return T.cause_histogram(verdicts(spark, sf))


def preferences(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = F.get(F.array(*[F.lit(k) for k in ("unsupported", "yes", "unsupported", "invalid", "unresolved")]), (F.col("l_suppkey") % 5).cast("int"))
    pref = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("deck"), pref.alias("pref"), F.concat(F.lit("e"), pref.cast("string")).alias("consumer"), kind.alias("kind"),
        F.when(kind != "yes", F.concat(F.lit("m"), pref.cast("string"))).alias("message"),
    )


ROUTE = """
WITH v AS (SELECT l_orderkey AS deck, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pref, list_extract(['unsupported', 'yes', 'unsupported', 'invalid', 'unresolved'], CAST(l_suppkey % 5 AS INTEGER) + 1) AS kind FROM lineitem),
s AS (SELECT deck, min(pref) FILTER (kind <> 'unsupported') AS stop, min(pref) AS first FROM v GROUP BY deck),
d AS (SELECT s.deck, stop, first, v.kind FROM s JOIN v ON v.deck = s.deck AND v.pref = coalesce(stop, first)),
n AS (SELECT v.deck, count(*) FILTER (stop IS NULL OR pref < stop) AS passed FROM v JOIN s USING (deck) GROUP BY v.deck)
"""


@query(
    "top4_route_by_preference",
    ROUTE + """SELECT d.deck, CASE WHEN kind = 'yes' THEN 'e' || stop END AS consumer, kind, CASE WHEN kind <> 'yes' THEN 'm' || coalesce(stop, first) END AS message,
    passed + CASE WHEN stop IS NOT NULL AND kind <> 'yes' THEN 1 ELSE 0 END AS rejected, CASE WHEN passed > 0 THEN 'm' || first END AS first_message FROM d JOIN n USING (deck)""",
)
def top4(spark, sf):
    return T.route_by_preference(preferences(spark, sf))


@query("top4_rejected", ROUTE + "SELECT v.deck, v.pref, v.kind FROM v JOIN s USING (deck) WHERE (stop IS NULL OR pref <= stop) AND kind <> 'yes'")
def top4_rejected(spark, sf):
    v = preferences(spark, sf)
    return T.rejected_before(v, T.route_by_preference(v)).select("deck", "pref", "kind")
