"""Numeric functions of the expression language, and engineering notation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of each engineering suffix, longest first.
SUFFIX_SCALE = {
    "meg": 1e6, "mil": 25.4e-6,
    "t": 1e12, "g": 1e9, "k": 1e3, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "μ": 1e-6,
    "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18,
}
# Printed suffixes, largest first.
PRINT_SCALE = [
    (1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""),
    (1e-3, "m"), (1e-6, "u"), (1e-9, "n"), (1e-12, "p"), (1e-15, "f"),
]
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*?)\s*$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A lambda computes every expression written into it at each place and for each
    entry; its own variable is only read.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def eng_parse(text: Column | str) -> Column:
    """``470u`` to 470e-6; unit words after the number count for nothing; NULL if no number."""
    c = _c(text)
    return _scaled(F.regexp_extract(c, NUMBER, 1), F.lower(F.regexp_extract(c, NUMBER, 2)))


def eng_parse_once(text: Column) -> Column:
    """``eng_parse`` for the inside of a lambda, where an expression is computed at each place it stands."""
    rest = F.lower(F.regexp_extract(text, NUMBER, 2))
    return bound(F.regexp_extract(text, NUMBER, 1), lambda m: bound(rest, lambda r: _scaled(m, r)))


def _scaled(mantissa: Column, rest: Column) -> Column:
    scale = F.lit(1.0)
    for suffix, value in reversed(SUFFIX_SCALE.items()):
        scale = F.when(F.startswith(rest, F.lit(suffix)), F.lit(value)).otherwise(scale)
    return F.when(mantissa != "", mantissa.cast("double") * scale)


def eng_format(value: Column | str, unit: str = "", digits: int = 4) -> Column:
    """``digits`` significant digits with a suffix; two-digit exponential below 1e-15."""
    v = _c(value).cast("double")
    size = F.abs(v)
    out = F.concat(_exponential(v, 2), F.lit(f" {unit}"))
    for scale, suffix in reversed(PRINT_SCALE):
        out = F.when(size >= scale, F.concat(_significant(v / scale, digits), F.lit(f" {suffix}{unit}"))).otherwise(out)
    return F.trim(F.when(size == 0, F.lit(f"0 {unit}")).otherwise(out))


def _exponential(v: Column, decimals: int) -> Column:
    text = F.format_string(f"%.{decimals}e", v)
    # exponents print without leading zeros
    return F.regexp_replace(text, r"e([+-])0*(\d)", "e$1$2")


def _significant(v: Column, digits: int) -> Column:
    """Fixed notation with ``digits`` significant digits (exponential from 10**digits on)."""
    size = F.abs(v)
    out = _exponential(v, digits - 1)
    for whole in range(digits, 0, -1):
        shown = F.format_string(f"%.{digits - whole}f", v)
        # a value that rounds up into the next decade loses one decimal
        out = F.when(size < 10.0**whole - 0.5 * 10.0 ** (whole - digits), shown).otherwise(out)
    return out


def normalize_signal(text: Column | str) -> Column:
    """``V(out)`` and ``I(x)`` to the name inside; anything else trimmed."""
    c = F.trim(_c(text))
    inner = F.regexp_extract(c, r"(?i)^[vi]\s*\(\s*([^)]+?)\s*\)$", 1)
    return F.when(inner != "", inner).otherwise(c)


def normalize_label(text: Column | str) -> Column:
    """``v1#branch`` to ``I(v1)``: one spelling of a current for every producer."""
    return F.regexp_replace(_c(text), r"(?i)^(.*)#branch$", "I($1)")


# -- expression functions; comparisons and logic give 1.0 or 0.0

fn_abs = F.abs
fn_exp = F.exp
fn_sin, fn_cos, fn_tan = F.sin, F.cos, F.tan
fn_asin, fn_acos, fn_atan = F.asin, F.acos, F.atan
fn_sinh, fn_cosh, fn_tanh = F.sinh, F.cosh, F.tanh
fn_atan2 = F.atan2
fn_pow = F.pow
fn_hypot = F.hypot


def fn_sqrt(x):
    return F.sqrt(F.when(_c(x) >= 0, _c(x)))


def fn_ln(x):
    return F.ln(F.when(_c(x) > 0, _c(x)))


fn_log = fn_ln


def fn_log10(x):
    return F.log10(F.when(_c(x) > 0, _c(x)))


def fn_floor(x):
    return F.floor(_c(x)).cast("double")


def fn_ceil(x):
    return F.ceil(_c(x)).cast("double")


def fn_int(x):
    c = _c(x)
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def fn_sgn(x):
    return F.signum(_c(x))


def fn_uramp(x):
    return F.greatest(_c(x).cast("double"), F.lit(0.0))


def fn_u(x):
    return (_c(x) > 0).cast("double")


def fn_pwr(x, y):
    return F.pow(F.abs(_c(x)), _c(y))


def fn_pwrs(x, y):
    return F.when(_c(x) < 0, -fn_pwr(x, y)).otherwise(fn_pwr(x, y))


def fn_min(x, y):
    return F.least(_c(x), _c(y))


def fn_max(x, y):
    return F.greatest(_c(x), _c(y))


def fn_if(c, a, b):
    return F.when(_c(c) != 0, _c(a)).otherwise(_c(b))


def fn_limit(x, a, b):
    return F.least(F.greatest(_c(x), F.least(_c(a), _c(b))), F.greatest(_c(a), _c(b)))


def number(condition: Column) -> Column:
    return condition.cast("double")


def truth(x) -> Column:
    return _c(x) != 0


def fn_and(a, b):
    return number(truth(a) & truth(b))


def fn_or(a, b):
    return number(truth(a) | truth(b))


def fn_not(a):
    return number(~truth(a))


def fn_mod(a, b):
    """Remainder with the sign of the left side; NULL for a zero divisor."""
    return F.try_mod(_c(a), _c(b))


def fn_div(a, b):
    return F.try_divide(_c(a), _c(b))


DB_FLOOR = 1e-300


def decibels(re, im) -> Column:
    size = F.hypot(_c(re), _c(im))
    return 20 * F.log10(F.when(size == 0, F.lit(DB_FLOOR)).otherwise(size))


def phase_degrees(re, im) -> Column:
    return F.degrees(F.atan2(_c(im), _c(re)))
