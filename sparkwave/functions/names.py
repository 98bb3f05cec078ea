"""Names, identifiers and symbol geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwave.functions.scalar import _c

# Fixed values
GROUND_NAMES = ("0", "gnd", "ground")
KIND_OF_TYPE = {
    "D": "diode", "NPN": "npn", "PNP": "pnp", "NMOS": "nmos", "PMOS": "pmos",
    "NJF": "njf", "PJF": "pjf", "SW": "sw",
}
GRID = 10
SYMBOL_SCALE = 0.2


def is_ground(name) -> Column:
    return F.lower(_c(name)).isin(*GROUND_NAMES)


def kind_for_model_type(type_, params) -> Column:
    """Placeable kind of a model type, NULL if it has none; VDMOS splits on its pchan flag."""
    token = F.upper(F.trim(_c(type_)))
    p_channel = F.rlike(F.coalesce(_c(params), F.lit("")), F.lit(r"(?i)(^|\s)pchan(\s|=|$)"))
    out = F.when(token == "VDMOS", F.when(p_channel, F.lit("pvdmos")).otherwise(F.lit("nvdmos")))
    for name, kind in KIND_OF_TYPE.items():
        out = out.when(token == name, F.lit(kind))
    return out


def part_id(name, path, line) -> Column:
    return F.concat(F.lit("lib:"), _c(name), F.lit("@"), _c(path), F.lit("#"), _c(line).cast("string"))


def part_label(name, path) -> Column:
    return F.concat(_c(name), F.lit(" — "), F.regexp_replace(_c(path), "^Models/", ""))


def hash36(text) -> Column:
    """32-bit FNV-1a over the characters, in base 36."""
    # Fixed values of the FNV-1a hash
    basis, prime = 0x811C9DC5, 0x01000193
    step = lambda h, ch: ((h.bitwiseXOR(F.ascii(ch).cast("long"))) * prime).bitwiseAND(0xFFFFFFFF)
    chars = F.filter(F.split(_c(text), ""), lambda ch: ch != "")
    return F.lower(F.conv(F.aggregate(chars, F.lit(basis).cast("long"), step).cast("string"), 10, 36))


def model_name(part_id_) -> Column:
    """A legal token for a part: library ids become ``name_hash``."""
    c = _c(part_id_)
    inner = F.regexp_extract(c, "^lib:([^@]*)", 1)
    base = F.regexp_replace(F.when(inner == "", F.lit("model")).otherwise(inner), "[^A-Za-z0-9_]", "_")
    return F.when(F.startswith(c, F.lit("lib:")), F.concat(base, F.lit("_"), hash36(c))).otherwise(c)


def snap(x) -> Column:
    return (F.floor(_c(x) / GRID + 0.5) * GRID).cast("long")


def rotate(dx, dy, rot, mirror) -> tuple[Column, Column]:
    """A local offset mirrored in x if asked, then turned by 0, 90, 180 or 270 degrees."""
    x = F.when(_c(mirror), -_c(dx)).otherwise(_c(dx))
    y = _c(dy)
    r = F.pmod(_c(rot), F.lit(360))
    return (
        F.when(r == 90, -y).when(r == 180, -x).when(r == 270, y).otherwise(x),
        F.when(r == 90, x).when(r == 180, -y).when(r == 270, -x).otherwise(y),
    )


def symbol_x(x) -> Column:
    return _c(x) * SYMBOL_SCALE


def symbol_y(y) -> Column:
    """Symbol files count upward, sheets downward."""
    return -_c(y) * SYMBOL_SCALE


def split_pins(text) -> Column:
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"[\s,]+"), lambda s: s != "")


def safe_path(path) -> Column:
    """False for empty paths and for paths with a ``.`` or ``..`` segment."""
    parts = F.filter(F.split(F.coalesce(_c(path), F.lit("")), "/"), lambda s: s != "")
    return (F.size(parts) > 0) & ~F.exists(parts, lambda s: s.isin(".", ".."))
