"""Symbol files (``DEF … ENDDEF`` records) to symbols, pins and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwave.functions.names import symbol_x, symbol_y

# Fields of each drawing record, counted from its letter.
UNIT_FIELD = {"S": 5, "C": 4, "A": 6, "P": 2, "X": 9}
NO_PINS_BOX = (-20.0, -20.0, 20.0, 20.0)


def _num(ix) -> Column:
    at = F.lit(ix) if isinstance(ix, int) else ix
    return F.get(F.col("t"), at).try_cast("double")


def _records(files: DataFrame) -> DataFrame:
    """Records of each complete symbol: (path, block, line, t, drawing)."""
    raw = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("_n", "_raw"))
    rows = raw.select("path", F.col("_n").alias("line"), F.regexp_replace("_raw", r"^\s+|\s+$", "").alias("rec"))
    rows = rows.where((F.col("rec") != "") & ~F.startswith(F.col("rec"), F.lit("#")))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.startswith(F.col("rec"), F.lit("DEF ")).cast("int")
    rows = rows.withColumn("block", F.sum(starts).over(so_far)).where(F.col("block") > 0)
    inside = Window.partitionBy("path", "block").orderBy("line")
    until_now = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("rec") == "ENDDEF").cast("int")).over(before), F.lit(0))
    switch = F.when(F.col("rec") == "DRAW", True).when(F.col("rec") == "ENDDRAW", False)
    whole = F.max((F.col("rec") == "ENDDEF").cast("int")).over(Window.partitionBy("path", "block"))
    return (
        rows.select(
            "path", "block", "line", "rec", F.split("rec", r"\s+").alias("t"),
            F.coalesce(F.last(switch, ignorenulls=True).over(until_now), F.lit(False)).alias("drawing"),
            ended.alias("_ended"), whole.alias("_whole"),
        )
        .where((F.col("_ended") == 0) & (F.col("_whole") == 1))
        .drop("_ended", "_whole")
    )


def extract_symbols(files: DataFrame) -> DataFrame:
    """``(name, ref, units, path, aliases, pins, shapes)``, one row per name and alias.

    Keeps the drawing of unit 0 and 1 in the normal body. Inside a file the last
    symbol of a name wins, and an alias never replaces a symbol.
    """
    letter = F.get(F.col("t"), F.lit(0))
    kept = F.lit(False)
    for rec, ix in UNIT_FIELD.items():
        ok = _num(ix).isin(0.0, 1.0) & _num(ix + 1).isin(0.0, 1.0)
        kept = F.when(letter == rec, F.coalesce(ok, F.lit(False))).otherwise(kept)
    draw = F.col("drawing") & kept
    text = lambda i: F.get(F.col("t"), F.lit(i))
    count = F.coalesce(_num(1), F.lit(0.0)).cast("int")
    pts = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array(_num(i * 2 + 5), _num(i * 2 + 6))
    )
    none = F.lit(None).cast("double")

    def shape(kind, x1, y1, x2=none, y2=none, r=none, a1=none, a2=none, points=None, fill=None):
        return F.struct(
            "line", F.lit(kind).alias("k"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
            r.alias("r"), a1.alias("a1"), a2.alias("a2"),
            (points if points is not None else F.lit(None).cast("array<array<double>>")).alias("pts"), fill.alias("fill"),
        )

    shapes = (
        F.when(letter == "S", shape("rect", _num(1), _num(2), _num(3), _num(4), fill=text(7)))
        .when(letter == "C", shape("circle", _num(1), _num(2), r=_num(3), fill=text(7)))
        .when(letter == "A", shape("arc", _num(1), _num(2), r=_num(3), a1=_num(4) / 10, a2=_num(5) / 10, fill=text(9)))
        .when(letter == "P", shape("poly", none, none, points=F.when(count > 0, pts), fill=F.get("t", count * 2 + 5)))
    )
    pin = F.when(
        (letter == "X") & text(6).isin("U", "D", "L", "R"),
        F.struct(
            "line", text(1).alias("name"), text(2).alias("num"), _num(3).alias("x"), _num(4).alias("y"),
            text(6).alias("dir"), _num(5).alias("len"),
        ),
    )
    rows = _records(files)
    is_def = F.startswith(F.col("rec"), F.lit("DEF "))
    alias = F.when(F.startswith(F.col("rec"), F.lit("ALIAS ")), F.struct("line", F.slice("t", 2, F.size("t")).alias("a")))
    header = F.when(is_def, F.struct(text(1).alias("name"), F.coalesce(text(2), F.lit("U")).alias("ref"), _num(7).alias("units")))
    drop_line = lambda a: F.transform(F.array_sort(a), lambda s: s.dropFields("line"))
    symbols = (
        rows.groupBy("path", "block")
        .agg(
            F.max(header).alias("h"),
            F.flatten(F.transform(F.array_sort(F.collect_list(alias)), lambda s: s["a"])).alias("aliases"),
            drop_line(F.collect_list(F.when(draw, pin))).alias("pins"),
            drop_line(F.collect_list(F.when(draw, shapes))).alias("shapes"),
        )
        .where(F.coalesce("h.name", F.lit("")) != "")
    )
    units = F.greatest(F.coalesce(F.when(F.col("h.units") != 0, F.col("h.units")), F.lit(1.0)), F.lit(1.0)).cast("int")
    own = F.array(F.struct(F.col("h.name").alias("name"), F.lit(0).alias("n")))
    others = F.transform("aliases", lambda a, i: F.struct(a.alias("name"), (i + 1).alias("n")))
    named = symbols.select(
        "path", "block", F.col("h.ref").alias("ref"), units.alias("units"), "aliases", "pins", "shapes",
        F.inline(F.concat(own, others)),
    )
    key = F.lower("name")
    # a symbol beats an alias; the last symbol and the first alias of a file win
    place = F.struct(
        F.when(F.col("n") == 0, 0).otherwise(1),
        F.when(F.col("n") == 0, -F.col("block")).otherwise(F.col("block")),
        "n",
    )
    best = named.groupBy("path", key.alias("key")).agg(
        F.min_by(F.struct("name", "ref", "units", "aliases", "pins", "shapes"), place).alias("s")
    )
    return best.select("path", "key", "s.*")


def symbol_pins(symbols: DataFrame) -> DataFrame:
    """Pins in sheet coordinates, by pin number; unnamed ones take their number."""
    number = lambda p: F.coalesce(F.regexp_extract(p["num"], r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    keyed = F.transform("pins", lambda p, i: F.struct(number(p).alias("o"), i.alias("i"), p.alias("p")))
    rows = symbols.select("path", "key", F.posexplode(F.array_sort(keyed)).alias("index", "_k"))
    p = F.col("_k.p")
    return rows.select(
        "path", "key", "index", F.when(p["name"] == "~", p["num"]).otherwise(p["name"]).alias("name"),
        p["num"].alias("num"), symbol_x(p["x"]).alias("x"), symbol_y(p["y"]).alias("y"),
    )


def symbol_bounds(symbols: DataFrame) -> DataFrame:
    """Box around body and pins in sheet coordinates."""
    at = lambda x, y: F.struct(symbol_x(x).alias("x"), symbol_y(y).alias("y"))
    radius = lambda s: F.abs(symbol_x(s["r"]))
    corner = lambda s, sign: F.struct(
        (symbol_x(s["x1"]) + sign * radius(s)).alias("x"), (symbol_y(s["y1"]) + sign * radius(s)).alias("y")
    )
    corners = F.flatten(
        F.transform(
            "shapes",
            lambda s: F.when(s["k"] == "rect", F.array(at(s["x1"], s["y1"]), at(s["x2"], s["y2"])))
            .when(s["k"].isin("circle", "arc"), F.array(corner(s, -1), corner(s, 1)))
            .otherwise(F.transform(F.coalesce(s["pts"], F.array().cast("array<array<double>>")), lambda q: at(q[0], q[1]))),
        )
    )
    pins = F.transform("pins", lambda p: at(p["x"], p["y"]))
    every = symbols.select("path", "key", F.explode_outer(F.concat(corners, pins)).alias("c"))
    box = every.groupBy("path", "key").agg(
        F.min("c.x").alias("x1"), F.min("c.y").alias("y1"), F.max("c.x").alias("x2"), F.max("c.y").alias("y2")
    )
    names = ("x1", "y1", "x2", "y2")
    return box.select("path", "key", *[F.coalesce(n, F.lit(d)).alias(n) for n, d in zip(names, NO_PINS_BOX)])
