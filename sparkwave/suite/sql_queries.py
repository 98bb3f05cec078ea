"""The same functions called from SQL text, against the same answers as the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwave.functions import sql as Q
from sparkwave.suite.function_queries import A_SQL, LIST, PART_IDS, SCALE_LIST, U_SQL, part_ids
from sparkwave.suite.registry import query, table


def asked(spark, df, expressions: dict[str, str], key: str):
    Q.register(spark)
    return df.select(key, *[F.expr(e).alias(name) for name, e in expressions.items()])


def _rounded(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0D"


CURVES = {
    "roots": (f"wave_sqrt({A_SQL}) + wave_ln({A_SQL}) * 2 + wave_log10({A_SQL}) * 4 + wave_exp({U_SQL})",
              f"CASE WHEN {A_SQL} > 0 THEN sqrt({A_SQL}) + ln({A_SQL}) * 2 + log10({A_SQL}) * 4 + exp({U_SQL}) END"),
    "angles": (f"wave_sin({U_SQL}) + wave_cos({U_SQL}) * 2 + wave_tan({U_SQL}) * 4 + wave_asin({U_SQL}) + wave_acos({U_SQL}) * 2 + wave_atan({U_SQL}) * 4",
               f"sin({U_SQL}) + cos({U_SQL}) * 2 + tan({U_SQL}) * 4 + asin({U_SQL}) + acos({U_SQL}) * 2 + atan({U_SQL}) * 4"),
    "hyperbolic": (f"wave_sinh({U_SQL}) + wave_cosh({U_SQL}) * 2 + wave_tanh({U_SQL}) * 4 + wave_atan2({A_SQL}, s_nationkey)",
                   f"sinh({U_SQL}) + cosh({U_SQL}) * 2 + tanh({U_SQL}) * 4 + atan2({A_SQL}, s_nationkey)"),
}


@query("sql_fn3_fn17_curves", "SELECT s_suppkey, " + ", ".join(f"round({duck}, 6) + 0.0 AS {n}" for n, (_, duck) in CURVES.items()) + " FROM supplier")
def curves(spark, sf):
    return asked(spark, table(spark, sf, "supplier"), {n: _rounded(e) for n, (e, _) in CURVES.items()}, "s_suppkey")


STEPS = {
    "whole": (f"wave_floor({A_SQL}) + wave_ceil({A_SQL}) * 2 + wave_int({A_SQL}) * 4 + wave_sgn({A_SQL}) * 8 + wave_abs({A_SQL})",
              f"floor({A_SQL}) + ceil({A_SQL}) * 2 + trunc({A_SQL}) * 4 + sign({A_SQL}) * 8 + abs({A_SQL})"),
    "steps": (f"wave_uramp({A_SQL}) + wave_u({A_SQL}) * 2 + wave_min({A_SQL}, 500) + wave_max({A_SQL}, 900) * 2 + wave_limit({A_SQL}, 4000, 100) * 4",
              f"greatest({A_SQL}, 0) + CASE WHEN {A_SQL} > 0 THEN 2 ELSE 0 END + least({A_SQL}, 500) + greatest({A_SQL}, 900) * 2 + least(greatest({A_SQL}, 100), 4000) * 4"),
    "powers": (f"wave_pow(abs({A_SQL}), 0.3D) + wave_pwr({A_SQL}, 0.5D) * 2 + wave_pwrs({A_SQL}, 0.5D) * 4",
               f"pow(abs({A_SQL}), 0.3) + pow(abs({A_SQL}), 0.5) * 2 + CASE WHEN {A_SQL} < 0 THEN -1 ELSE 1 END * pow(abs({A_SQL}), 0.5) * 4"),
    "logic": (f"wave_if(s_nationkey % 3, {A_SQL}, -1) + wave_and(s_nationkey % 2, s_nationkey % 3) + wave_or(s_nationkey % 2, s_nationkey % 3) * 2 + wave_not(s_nationkey % 5) * 4 "
              f"+ wave_mod({A_SQL}, 7) + wave_div({A_SQL}, s_nationkey + 1)",
              f"CASE WHEN s_nationkey % 3 <> 0 THEN {A_SQL} ELSE -1 END + CAST(s_nationkey % 2 <> 0 AND s_nationkey % 3 <> 0 AS INT) + CAST(s_nationkey % 2 <> 0 OR s_nationkey % 3 <> 0 AS INT) * 2 "
              f"+ CAST(s_nationkey % 5 = 0 AS INT) * 4 + {A_SQL} % 7.0 + {A_SQL} / (s_nationkey + 1)"),
    "response": (f"wave_decibels({A_SQL}, 3) + wave_hypot({A_SQL}, 4) + wave_phase_degrees({A_SQL}, 5)",
                 f"20 * log10(sqrt({A_SQL} * {A_SQL} + 9.0)) + sqrt({A_SQL} * {A_SQL} + 16.0) + degrees(atan2(5.0, {A_SQL}))"),
}


@query("sql_fn11_fn24_steps", "SELECT s_suppkey, " + ", ".join(f"round({duck}, 4) + 0.0 AS {n}" for n, (_, duck) in STEPS.items()) + " FROM supplier")
def steps(spark, sf):
    return asked(spark, table(spark, sf, "supplier"), {n: _rounded(e, 4) for n, (e, _) in STEPS.items()}, "s_suppkey")


@query(
    "sql_fn1_fn28_parts",
    f"""{PART_IDS}, n AS (SELECT p_partkey, CASE WHEN p_partkey % 16 = 15 THEN NULL ELSE
          CAST(CAST(p_size AS VARCHAR) || '.5' AS DOUBLE) * CAST(list_extract([{SCALE_LIST}]::DOUBLE[], CAST(p_partkey % 16 AS INTEGER) + 1) AS DOUBLE) END AS value,
          CAST(floor(p_retailprice / 10 + 0.5) * 10 AS BIGINT) AS snapped, p_partkey % 3 = 0 AS ground FROM part)
    SELECT p_partkey, value, snapped, ground, 'lib:' || name || '@' || path || '#' || p_partkey AS id, name || ' — ' || substr(path, 8) AS label, name AS signal FROM n JOIN q USING (p_partkey)""",
)
def parts(spark, sf):
    text = f"CASE WHEN p_partkey % 16 < 15 THEN concat(p_size, '.5', element_at(array({LIST}), CAST(p_partkey % 16 AS INT) + 1)) ELSE p_name END"
    both = table(spark, sf, "part").join(part_ids(spark, sf), "p_partkey")
    expressions = {
        "value": f"wave_eng_parse({text})", "snapped": "wave_snap(p_retailprice)", "ground": "wave_is_ground(CASE WHEN p_partkey % 3 = 0 THEN 'Gnd' ELSE 'out' END)",
        "id": "wave_part_id(name, path, p_partkey)", "label": "wave_part_label(name, path)", "signal": "wave_normalize_signal(concat(' V( ', name, ' )'))",
    }
    return asked(spark, both, expressions, "p_partkey")
