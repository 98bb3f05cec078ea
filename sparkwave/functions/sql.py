"""The column functions as SQL functions, whose bodies Spark puts into the query's own plan.

``register(spark)`` makes them for the session; their names start with ``wave_``. Each is
the twin of the column function of that name and gives the same values.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkwave.functions.names import GRID, GROUND_NAMES
from sparkwave.functions.scalar import DB_FLOOR, NUMBER, SUFFIX_SCALE

_X, _XY = "x DOUBLE", "x DOUBLE, y DOUBLE"
_REST = f"lower(regexp_extract(text, r'{NUMBER}', 2))"
_SCALE = " ".join(f"WHEN startswith({_REST}, '{suffix}') THEN {value!r}D" for suffix, value in SUFFIX_SCALE.items())
_SIGNAL = r"(?i)^[vi]\s*\(\s*([^)]+?)\s*\)$"

#: Name, parameters, type and body.
FUNCTIONS = (
    *((f, _X, "DOUBLE", f"{f}(x)") for f in "abs exp sin cos tan asin acos atan sinh cosh tanh".split()),
    ("sqrt", _X, "DOUBLE", "CASE WHEN x >= 0 THEN sqrt(x) END"),
    ("ln", _X, "DOUBLE", "CASE WHEN x > 0 THEN ln(x) END"),
    ("log10", _X, "DOUBLE", "CASE WHEN x > 0 THEN log10(x) END"),
    ("floor", _X, "DOUBLE", "CAST(floor(x) AS DOUBLE)"),
    ("ceil", _X, "DOUBLE", "CAST(ceil(x) AS DOUBLE)"),
    ("int", _X, "DOUBLE", "CAST(CASE WHEN x < 0 THEN ceil(x) ELSE floor(x) END AS DOUBLE)"),
    ("sgn", _X, "DOUBLE", "signum(x)"),
    ("uramp", _X, "DOUBLE", "greatest(x, 0D)"),
    ("u", _X, "DOUBLE", "CAST(x > 0 AS DOUBLE)"),
    ("atan2", "y DOUBLE, x DOUBLE", "DOUBLE", "atan2(y, x)"),
    ("pow", _XY, "DOUBLE", "pow(x, y)"),
    ("pwr", _XY, "DOUBLE", "pow(abs(x), y)"),
    ("pwrs", _XY, "DOUBLE", "CASE WHEN x < 0 THEN -pow(abs(x), y) ELSE pow(abs(x), y) END"),
    ("min", _XY, "DOUBLE", "least(x, y)"),
    ("max", _XY, "DOUBLE", "greatest(x, y)"),
    ("if", "c DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN c <> 0 THEN a ELSE b END"),
    ("limit", "x DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", "least(greatest(x, least(a, b)), greatest(a, b))"),
    ("and", _XY, "DOUBLE", "CAST(x <> 0 AND y <> 0 AS DOUBLE)"),
    ("or", _XY, "DOUBLE", "CAST(x <> 0 OR y <> 0 AS DOUBLE)"),
    ("not", _X, "DOUBLE", "CAST(NOT x <> 0 AS DOUBLE)"),
    ("mod", _XY, "DOUBLE", "try_mod(x, y)"),
    ("div", _XY, "DOUBLE", "try_divide(x, y)"),
    ("hypot", _XY, "DOUBLE", "hypot(x, y)"),
    ("decibels", "re DOUBLE, im DOUBLE", "DOUBLE", f"20 * log10(CASE WHEN hypot(re, im) = 0 THEN {DB_FLOOR!r}D ELSE hypot(re, im) END)"),
    ("phase_degrees", "re DOUBLE, im DOUBLE", "DOUBLE", "degrees(atan2(im, re))"),
    ("eng_parse", "text STRING", "DOUBLE", f"CASE WHEN regexp_extract(text, r'{NUMBER}', 1) <> '' THEN CAST(regexp_extract(text, r'{NUMBER}', 1) AS DOUBLE) * CASE {_SCALE} ELSE 1D END END"),
    ("is_ground", "name STRING", "BOOLEAN", f"lower(name) IN ({', '.join(map(repr, sorted(GROUND_NAMES)))})"),
    ("normalize_signal", "text STRING", "STRING", f"CASE WHEN regexp_extract(trim(text), r'{_SIGNAL}', 1) <> '' THEN regexp_extract(trim(text), r'{_SIGNAL}', 1) ELSE trim(text) END"),
    ("part_id", "name STRING, path STRING, line BIGINT", "STRING", "concat('lib:', name, '@', path, '#', CAST(line AS STRING))"),
    ("part_label", "name STRING, path STRING", "STRING", "concat(name, ' — ', regexp_replace(path, '^Models/', ''))"),
    ("snap", _X, "BIGINT", f"CAST(floor(x / {GRID} + 0.5D) * {GRID} AS BIGINT)"),
)


def register(spark: SparkSession) -> None:
    """Make (or replace) the functions in the session of ``spark``."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wave_{name}({parameters}) RETURNS {kind} RETURN {body}")
