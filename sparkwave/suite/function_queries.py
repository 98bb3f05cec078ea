"""Column functions over whole part, supplier and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwave.functions import names as N
from sparkwave.functions import scalar as X
from sparkwave.suite.registry import query, rounded, table

SUFFIXES = ("", "k", "meg", "mil", "u", "µF", "n", "ohm", "T", "x9", "p", "f", "a", "G", "M")
SCALES = ("1", "1e3", "1e6", "25.4e-6", "1e-6", "1e-6", "1e-9", "1", "1e12", "1", "1e-12", "1e-15", "1e-18", "1e9", "1e-3")
LIST = ", ".join(f"'{s}'" for s in SUFFIXES)
SCALE_LIST = ", ".join(SCALES)


@query(
    "fn1_eng_parse",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 16 = 15 THEN NULL ELSE
      CAST(CAST(p_size AS VARCHAR) || '.5' AS DOUBLE) * CAST(list_extract([{SCALE_LIST}]::DOUBLE[], CAST(p_partkey % 16 AS INTEGER) + 1) AS DOUBLE) END AS x FROM part""",
)
def fn1(spark, sf):
    p = table(spark, sf, "part")
    ix = F.col("p_partkey") % 16
    text = F.when(ix == 15, F.col("p_name")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(".5"), F.get(F.array(*[F.lit(s) for s in SUFFIXES]), ix.cast("int")))
    )
    return p.select("p_partkey", X.eng_parse(text).alias("x"))


@query(
    "fn2_eng_format",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '0 V'
         WHEN p_partkey % 4 = 1 THEN printf('%.3f uV', p_size / 10.0 + 1)
         WHEN p_partkey % 4 = 2 THEN printf('%.2f kV', p_size + 10.0)
         ELSE (p_size % 9 + 1) || '.00e-16 V' END AS x FROM part""",
)
def fn2(spark, sf):
    p = table(spark, sf, "part")
    ix = F.col("p_partkey") % 4
    size = F.col("p_size").cast("double")
    v = F.when(ix == 0, F.lit(0.0)).when(ix == 1, (size / 10 + 1) * 1e-6).when(ix == 2, (size + 10) * 1000).otherwise((F.col("p_size") % 9 + 1) * 1e-16)
    return p.select("p_partkey", X.eng_format(v, "V").alias("x"))


NUM = "SELECT s_suppkey, {value} AS x FROM supplier"


def _one(name: str, column, sql: str, digits: int = 6):
    @query(name, NUM.format(value=f"round({sql}, {digits}) + 0.0"))
    def run(spark, sf, column=column, digits=digits):
        return table(spark, sf, "supplier").select("s_suppkey", rounded(column(), digits, "x"))


A, A_SQL = (lambda: F.col("s_acctbal")), "s_acctbal"
U, U_SQL = (lambda: F.col("s_acctbal") / 10000), "(s_acctbal / 10000)"

_one("fn3_abs", lambda: X.fn_abs(A()), f"abs({A_SQL})")
_one("fn4_sqrt", lambda: X.fn_sqrt(A()), f"CASE WHEN {A_SQL} >= 0 THEN sqrt({A_SQL}) END")
_one("fn5_exp", lambda: X.fn_exp(U()), f"exp({U_SQL})")
_one("fn6_ln", lambda: X.fn_ln(A()), f"CASE WHEN {A_SQL} > 0 THEN ln({A_SQL}) END")
_one("fn7_log10", lambda: X.fn_log10(A()), f"CASE WHEN {A_SQL} > 0 THEN log10({A_SQL}) END")
_one("fn8_sin_cos_tan", lambda: X.fn_sin(U()) + X.fn_cos(U()) * 2 + X.fn_tan(U()) * 4, f"sin({U_SQL}) + cos({U_SQL}) * 2 + tan({U_SQL}) * 4")
_one("fn9_asin_acos_atan", lambda: X.fn_asin(U()) + X.fn_acos(U()) * 2 + X.fn_atan(U()) * 4, f"asin({U_SQL}) + acos({U_SQL}) * 2 + atan({U_SQL}) * 4")
_one("fn10_sinh_cosh_tanh", lambda: X.fn_sinh(U()) + X.fn_cosh(U()) * 2 + X.fn_tanh(U()) * 4, f"sinh({U_SQL}) + cosh({U_SQL}) * 2 + tanh({U_SQL}) * 4")
_one("fn11_floor_ceil", lambda: X.fn_floor(A()) + X.fn_ceil(A()) * 2, f"floor({A_SQL}) + ceil({A_SQL}) * 2")
_one("fn12_int", lambda: X.fn_int(A()), f"trunc({A_SQL})")
_one("fn13_sgn", lambda: X.fn_sgn(A()), f"CAST(sign({A_SQL}) AS DOUBLE)")
_one("fn14_uramp", lambda: X.fn_uramp(A()), f"greatest({A_SQL}, 0)")
_one("fn15_u", lambda: X.fn_u(A()), f"CASE WHEN {A_SQL} > 0 THEN 1.0::DOUBLE ELSE 0 END")
_one("fn16_atan2", lambda: X.fn_atan2(A(), F.col("s_nationkey").cast("double")), f"atan2({A_SQL}, s_nationkey)")
_one("fn17_pow", lambda: X.fn_pow(F.abs(A()), F.lit(0.3)), f"pow(abs({A_SQL}), 0.3)")
_one("fn18_pwr", lambda: X.fn_pwr(A(), F.lit(0.5)), f"pow(abs({A_SQL}), 0.5)")
_one("fn19_pwrs", lambda: X.fn_pwrs(A(), F.lit(0.5)), f"CASE WHEN {A_SQL} < 0 THEN -1 ELSE 1 END * pow(abs({A_SQL}), 0.5)")
_one("fn20_min_max", lambda: X.fn_min(A(), F.lit(500.0)) + X.fn_max(A(), F.lit(900.0)) * 2, f"least({A_SQL}, 500) + greatest({A_SQL}, 900) * 2")
_one("fn21_if", lambda: X.fn_if(F.col("s_nationkey") % 3, A(), F.lit(-1.0)), f"CASE WHEN s_nationkey % 3 <> 0 THEN {A_SQL} ELSE -1 END")
_one("fn22_limit", lambda: X.fn_limit(A(), F.lit(4000.0), F.lit(100.0)), f"least(greatest({A_SQL}, 100), 4000)")
_one(
    "fn23_operators",
    lambda: X.fn_and(F.col("s_nationkey") % 2, F.col("s_nationkey") % 3) + X.fn_or(F.col("s_nationkey") % 2, F.col("s_nationkey") % 3) * 2
    + X.fn_not(F.col("s_nationkey") % 5) * 4 + X.number(A() >= 5000) * 8 + X.fn_mod(A(), F.lit(7.0)) + X.fn_div(A(), F.col("s_nationkey").cast("double") + 1),
    f"CAST(s_nationkey % 2 <> 0 AND s_nationkey % 3 <> 0 AS INT) + CAST(s_nationkey % 2 <> 0 OR s_nationkey % 3 <> 0 AS INT) * 2 "
    f"+ CAST(s_nationkey % 5 = 0 AS INT) * 4 + CAST({A_SQL} >= 5000 AS INT) * 8 + {A_SQL} % 7.0 + {A_SQL} / (s_nationkey + 1)",
    4,
)
_one(
    "fn24_hypot_db_degrees",
    lambda: X.decibels(A(), F.lit(3.0)) + X.fn_hypot(A(), F.lit(4.0)) + X.phase_degrees(A(), F.lit(5.0)),
    f"20 * log10(sqrt({A_SQL} * {A_SQL} + 9.0)) + sqrt({A_SQL} * {A_SQL} + 16.0) + degrees(atan2(5.0, {A_SQL}))",
)

TYPES = ("D", "npn ", "PNP", "nmos", "PMOS", "NJF", "PJF", "VDMOS", "VDMOS", "SW", "VSWITCH")
KINDS = ("diode", "npn", "pnp", "nmos", "pmos", "njf", "pjf", "nvdmos", "pvdmos", "sw")


@query(
    "fn25_kind_for_model_type",
    f"SELECT p_partkey, list_extract([{', '.join(repr(k) for k in KINDS)}, NULL], CAST(p_partkey % 11 AS INTEGER) + 1) AS kind FROM part",
)
def fn25(spark, sf):
    p = table(spark, sf, "part")
    ix = (F.col("p_partkey") % 11).cast("int")
    params = F.when(ix == 8, F.lit("vto=1 PCHAN kp=2")).otherwise(F.lit("vto=1 pchannel=0"))
    return p.select("p_partkey", N.kind_for_model_type(F.get(F.array(*[F.lit(t) for t in TYPES]), ix), params).alias("kind"))


def part_ids(spark, sf):
    p = table(spark, sf, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    path = F.concat(F.lit("Models/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("/")), F.lit(".lib"))
    return p.select("p_partkey", name.alias("name"), path.alias("path"))


PART_IDS = "WITH q AS (SELECT p_partkey, replace(p_name, ' ', '-') AS name, 'Models/' || replace(p_brand, '#', '/') || '.lib' AS path FROM part)"


@query(
    "fn26_part_id_label",
    PART_IDS + " SELECT p_partkey, 'lib:' || name || '@' || path || '#' || p_partkey AS id, name || ' — ' || substr(path, 8) AS label FROM q",
)
def fn26(spark, sf):
    return part_ids(spark, sf).select("p_partkey", N.part_id("name", "path", "p_partkey").alias("id"), N.part_label("name", "path").alias("label"))


@query(
    "fn27_model_name",
    PART_IDS.replace("WITH", "WITH RECURSIVE") + """, d AS (SELECT DISTINCT name, path, 'lib:' || name || '@' || path AS id FROM q),
    h AS (SELECT id, 0 AS n, CAST(2166136261 AS BIGINT) AS h FROM d
          UNION ALL SELECT id, n + 1, CAST((CAST(xor(h, ascii(substr(id, n + 1, 1))) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE n < length(id)),
    f AS (SELECT id, h FROM h WHERE n = length(id)),
    b AS (SELECT id, h AS rest, '' AS txt FROM f UNION ALL
          SELECT id, rest // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(rest % 36 AS INTEGER) + 1, 1) || txt FROM b WHERE rest > 0),
    t AS (SELECT id, txt FROM b WHERE rest = 0)
    SELECT q.p_partkey, regexp_replace(q.name, '[^A-Za-z0-9_]', '_', 'g') || '_' || t.txt AS token FROM q JOIN t ON t.id = 'lib:' || q.name || '@' || q.path""",
)
def fn27(spark, sf):
    return part_ids(spark, sf).select("p_partkey", N.model_name(F.concat(F.lit("lib:"), "name", F.lit("@"), "path")).alias("token"))


@query("fn28_snap", "SELECT p_partkey, CAST(floor(p_retailprice / 10 + 0.5) * 10 AS BIGINT) AS x FROM part")
def fn28(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.snap("p_retailprice").alias("x"))


@query(
    "fn29_rotate",
    """WITH q AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN -p_size ELSE p_size END AS x, 3 AS y, (p_partkey % 8 - 4) * 90 AS r0 FROM part),
    t AS (SELECT *, ((r0 % 360) + 360) % 360 AS r FROM q)
    SELECT p_partkey, CASE r WHEN 90 THEN -y WHEN 180 THEN -x WHEN 270 THEN y ELSE x END AS x, CASE r WHEN 90 THEN x WHEN 180 THEN -y WHEN 270 THEN -x ELSE y END AS y FROM t""",
)
def fn29(spark, sf):
    p = table(spark, sf, "part")
    x, y = N.rotate("p_size", F.lit(3), (F.col("p_partkey") % 8 - 4) * 90, F.col("p_size") % 2 == 0)
    return p.select("p_partkey", x.alias("x"), y.alias("y"))


@query("fn30_symbol_scale", "SELECT p_partkey, round(p_size * 0.2, 6) AS x, round(-p_size * 0.2, 6) AS y FROM part")
def fn30(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rounded(N.symbol_x("p_size"), 6, "x"), rounded(N.symbol_y("p_size"), 6, "y"))


@query("fn31_is_ground", "SELECT p_partkey, p_size % 4 < 3 AS ground FROM part")
def fn31(spark, sf):
    names = F.array(F.lit("0"), F.lit("GND"), F.lit("Ground"), F.lit("gnd2"))
    return table(spark, sf, "part").select("p_partkey", N.is_ground(F.get(names, F.col("p_size") % 4)).alias("ground"))


@query(
    "fn32_split_pins",
    "SELECT p_partkey, unnest(list_filter(string_split_regex(p_name || ' , ' || p_brand || ',,', '[\\s,]+'), lambda x: x <> '')) AS pin FROM part",
)
def fn32(spark, sf):
    text = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(",,"))
    return table(spark, sf, "part").select("p_partkey", F.explode(N.split_pins(text)).alias("pin"))


@query("fn33_normalize_signal", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'V' || p_name ELSE p_name END AS sig FROM part")
def fn33(spark, sf):
    k = F.col("p_size") % 3
    n = F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit(" V"), n, F.lit(" "))).when(k == 1, F.concat(F.lit("i( "), n, F.lit(" )"))).otherwise(F.concat(F.lit("V("), n, F.lit(")")))
    return table(spark, sf, "part").select("p_partkey", X.normalize_signal(text).alias("sig"))


@query(
    "prj5_normalize_label",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'I(' || c_name || ')' ELSE c_name || '#branched' END AS label FROM customer",
)
def prj5(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("#BRANCH"))).otherwise(F.concat("c_name", F.lit("#branched")))
    return table(spark, sf, "customer").select("c_custkey", X.normalize_label(text).alias("label"))
