"""Ordered work inside a key without putting the key into one task.

A window over ``partitionBy(key)`` sorts a whole key in one task. When one key
holds a large part of the table that task never ends. Here every key with more
than ``rows`` rows is cut into consecutive pieces along its order axis, pieces
that are still too large are cut again, and windows run per (key, piece). What
has to cross a piece border (the neighbouring sample, the rank so far, the last
known value) is computed from one row per piece.

Pieces are plain arithmetic on the axis value, so samples and query points of
the same key always fall into the same piece.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwave.plans.lineage import cut
from sparkwave.plans.sizing import BROADCAST_ROWS

ROWS_PER_CHUNK = 1_000_000
#: Cuts of cuts. The numbers of all levels share the bits of a long, more than the digits of a double.
LEVELS = 6
_NUMBERS = 1 << 62
_MAX_PIECES = 1 << 20

CHUNK, FIRST, LAST, HOT = "_chunk", "_first", "_last", "_hot"
COLUMNS = (CHUNK, FIRST, LAST, HOT)
_CUT = ("_m", "_lo", "_hi", "_tlo", "_thi")


@dataclass
class Chunks:
    """How the hot keys of one table are split; empty when no key is hot."""

    keys: tuple[str, ...]
    #: the pieces that are cut, and the most pieces that one of them becomes
    levels: list[tuple[DataFrame, int]] = field(default_factory=list)

    @property
    def split(self) -> bool:
        return bool(self.levels)

    def assign(self, df: DataFrame, x: str, tie: str | None = None) -> DataFrame:
        """Add the piece number and its flags; order of pieces follows (x, tie)."""
        out = df.select(
            "*",
            F.lit(0).cast("long").alias(CHUNK),
            F.lit(True).alias(FIRST),
            F.lit(True).alias(LAST),
            F.lit(False).alias(HOT),
        )
        for level, fan in self.levels:
            out = out.join(level, [*self.keys, CHUNK], "left")
            piece = F.coalesce(_piece(F.col(x), F.col(tie) if tie else None), F.lit(0))
            kept = [c for c in out.columns if c not in (*COLUMNS, *_CUT)]
            out = out.select(
                *kept,
                (F.col(CHUNK) * fan + piece).alias(CHUNK),
                (F.col(FIRST) & (piece == 0)).alias(FIRST),
                (F.col(LAST) & (piece == F.coalesce("_m", F.lit(1)) - 1)).alias(LAST),
                (F.col(HOT) | F.col("_m").isNotNull()).alias(HOT),
            )
        return out


def _piece(x: Column, tie: Column | None) -> Column:
    """Equal-width piece of [lo, hi]; rows at one single instant split by ordinal."""
    m = F.col("_m")
    share = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    same = F.when(x <= F.col("_lo"), F.lit(0.0)).otherwise(F.lit(1.0))
    if tie is not None:
        width = F.greatest(F.col("_thi") - F.col("_tlo"), F.lit(1)).cast("double")
        same = F.when(x == F.col("_lo"), (tie - F.col("_tlo")) / width).otherwise(same)
    place = F.floor(F.when(F.col("_hi") > F.col("_lo"), share).otherwise(same) * m)
    return F.least(F.greatest(place, F.lit(0).cast("long")), m - 1)


def plan_chunks(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    tie: str | None = None,
    rows: int | None = None,
) -> Chunks:
    """Find the keys above ``rows`` rows and how to cut them.

    One aggregate over the key and axis columns per level, from the second level on only
    over the rows of pieces that were cut, which are written from the third level on.
    Pieces are made half full, so that evenly spread rows need one level. A list of at
    most ``BROADCAST_ROWS`` pieces is taken as a literal table; a longer one, of up to
    N / rows, is a written table, since every table that is assigned reads it again.
    """
    rows = rows or ROWS_PER_CHUNK
    found, numbers, stuck = Chunks(tuple(keys)), 1, 0
    at, ordinal = F.col(x), F.col(tie) if tie else None
    source = df.select(*keys, x, *([tie] if tie else []), F.lit(0).cast("long").alias(CHUNK))
    for depth in range(LEVELS + 1):
        if depth:
            level, fan = found.levels[-1]
            place = F.coalesce(_piece(at, ordinal), F.lit(0))
            source = source.join(level, [*keys, CHUNK]).select(
                *keys, x, *([tie] if tie else []), (F.col(CHUNK) * fan + place).alias(CHUNK)
            )
            if depth > 1:
                source = cut(source)
        over = _over_full(source, keys, x, tie, rows, min(_MAX_PIECES, _NUMBERS // numbers))
        if depth:
            over = cut(over)
        some = over.limit(BROADCAST_ROWS + 1).collect()
        if len(some) > BROADCAST_ROWS:
            over = over if depth else cut(over)
            level = over.where("_cuts").drop("_cuts")
            count, fan = level.agg(F.count(F.lit(1)), F.max("_m")).first()
            stuck += over.count() - count
            if count <= BROADCAST_ROWS:
                level = F.broadcast(level)
        else:
            cuts = [r for r in some if r["_cuts"]]
            count, fan = len(cuts), max((r["_m"] for r in cuts), default=None)
            stuck += len(some) - count
            # a literal table of counted size
            level = F.broadcast(df.sparkSession.createDataFrame(cuts, over.schema).drop("_cuts")) if cuts else None
        if not count:
            break
        if depth == LEVELS or fan < 2:
            stuck += count
            break
        numbers *= fan
        found.levels.append((level, fan))
    if stuck:
        warnings.warn(f"{stuck} piece(s) of over {rows} samples at one place cannot be cut any further", stacklevel=2)
    return found


def _over_full(source: DataFrame, keys: Sequence[str], x: str, tie: str | None, rows: int, most: int) -> DataFrame:
    """The pieces of over ``rows`` rows, into how many they go, and whether there is anything to cut them by."""
    n, wide = F.col("_n"), F.col("_hi") > F.col("_lo")
    # at one instant only the rows with an ordinal can be told apart
    by_tie = (F.col("_thi") > F.col("_tlo")) & (F.col("_ties") > rows) if tie else F.lit(False)
    return (
        source.groupBy(*keys, CHUNK)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(x).cast("double").alias("_lo"),
            F.max(x).cast("double").alias("_hi"),
            (F.min(tie) if tie else F.lit(None)).cast("long").alias("_tlo"),
            (F.max(tie) if tie else F.lit(None)).cast("long").alias("_thi"),
            F.count(tie if tie else F.lit(None)).alias("_ties"),
        )
        .where(n > rows)
        .select(
            *keys, CHUNK,
            F.least(F.ceil(2 * n / rows), F.lit(most)).cast("long").alias("_m"),
            "_lo", "_hi", "_tlo", "_thi",
            F.coalesce(wide | by_tie, F.lit(False)).alias("_cuts"),
        )
    )


def piece_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    tie: str,
    value: str,
    chunks: Chunks,
) -> DataFrame:
    """Each row with the axis value before it and the row after it.

    Adds ``x_prev``, ``x_next``, ``v_next`` and ``x_first`` / ``x_last``: the
    ends of the key, exact on the pieces that hold an end and minus/plus
    infinity elsewhere.
    """
    keyed = chunks.assign(df, x, tie).withColumn("_ghost", F.lit(False))
    if chunks.split:
        keyed = keyed.unionByName(_border_rows(keyed, keys, x, tie, value), allowMissingColumns=True)
    whole = piece_window(keys)
    # a ghost stands at the border it comes from, whatever its ordinal
    order = whole.orderBy(x, tie)
    own = F.when(~F.col("_ghost"), F.col(x))
    out = keyed.select(
        "*",
        F.lag(x).over(order).alias("x_prev"),
        F.lead(x).over(order).alias("x_next"),
        F.lead(value).over(order).alias("v_next"),
        F.when(F.col(FIRST), F.min(own).over(whole)).otherwise(F.lit(float("-inf"))).alias("x_first"),
        F.when(F.col(LAST), F.max(own).over(whole)).otherwise(F.lit(float("inf"))).alias("x_last"),
    )
    return out.where(~F.col("_ghost")).drop("_ghost", FIRST, LAST, HOT)


def _border_rows(keyed: DataFrame, keys: Sequence[str], x: str, tie: str, value: str) -> DataFrame:
    """Copies of the rows next to a piece border, placed on its other side."""
    row = F.struct(x, tie, value)
    ends = (
        keyed.where(F.col(HOT))
        .groupBy(*keys, CHUNK)
        .agg(F.min(row).alias("_head"), F.max(row).alias("_tail"))
    )
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    around = ends.select(
        *keys,
        CHUNK,
        F.array(F.lag("_tail").over(along), F.lead("_head").over(along)).alias("_both"),
    )
    around = around.select(*keys, CHUNK, F.explode("_both").alias("_row")).where(F.col("_row").isNotNull())
    return around.select(
        *keys,
        CHUNK,
        F.col(f"_row.{x}").alias(x),
        F.col(f"_row.{tie}").alias(tie),
        F.col(f"_row.{value}").alias(value),
        F.lit(False).alias(FIRST),
        F.lit(False).alias(LAST),
        F.lit(True).alias(HOT),
        F.lit(True).alias("_ghost"),
    )


def ranked(
    keyed: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    rank: str,
    split: bool,
) -> DataFrame:
    """1-based position inside the key, for rows that carry a piece number."""
    inside = F.row_number().over(piece_window(keys).orderBy(*order)).cast("long")
    if not split:
        return keyed.withColumn(rank, inside)
    before = pieces_before(keyed, keys)
    return (
        keyed.join(before, [*keys, CHUNK])
        .withColumn(rank, inside + F.col("_before"))
        .drop("_before", "_rows")
    )


def pieces_before(keyed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the key that lie in earlier pieces: one line per piece."""
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    sums = along.rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(sums), F.lit(0).cast("long")))
    )


def before_pieces(df: DataFrame, keys: Sequence[str], piece: str, summaries: dict) -> DataFrame:
    """What lies before each piece of a key: ``summaries`` maps a name to (aggregate of a piece, how pieces combine).

    One row per piece is all that crosses a border; the first piece gets NULLs.
    """
    along = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, piece).agg(*[made.alias(name) for name, (made, _) in summaries.items()])
    return parts.select(*keys, piece, *[combine(name).over(along).alias(name) for name, (_, combine) in summaries.items()])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, value: Column, piece: str | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to each row of its key, also where the key comes in numbered pieces."""
    if piece is None:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(so_far))
    here = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = before_pieces(df, keys, piece, {"_earlier": (F.sum(value), F.sum)})
    total = F.sum(value).over(here) + F.coalesce("_earlier", F.lit(0))
    return df.join(earlier, [*keys, piece]).withColumn(name, total).drop("_earlier")


def nth_in_key(
    keyed: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    nth: Column,
    split: bool,
) -> DataFrame:
    """Only the ``nth`` row of each key; other pieces are never sorted."""
    if split:
        before = pieces_before(keyed, keys)
        keyed = keyed.join(before, [*keys, CHUNK]).where(
            (nth > F.col("_before")) & (nth <= F.col("_before") + F.col("_rows"))
        )
        wanted = nth - F.col("_before")
    else:
        wanted = nth
    place = F.row_number().over(piece_window(keys).orderBy(*order)).cast("long")
    return (
        keyed.withColumn("_place", place)
        .where(F.col("_place") == wanted)
        .drop("_place", "_before", "_rows")
    )


def last_known(
    samples: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    sample_x: str,
    sample_tie: str,
    point_x: str,
    payload: Sequence[str],
    chunks: Chunks,
) -> DataFrame:
    """For every point the last sample strictly before it, else the first sample.

    Samples and points are sorted together once per (key, piece); a piece whose
    beginning has no sample gets the last one of the pieces before it.
    """
    s = chunks.assign(samples, sample_x, sample_tie)
    p = chunks.assign(points, point_x)
    row = F.struct(F.col(sample_x).alias("_x"), F.col(sample_tie).alias("_i"), *payload)
    extra = [c for c in points.columns if c not in keys]
    left = s.select(
        *keys, CHUNK, F.col(sample_x).cast("double").alias("_at"), F.lit(1).alias("_side"),
        row.alias("_row"), F.lit(None).cast(_struct_of(points, extra)).alias("_point"),
    )
    row_type = left.schema["_row"].dataType
    right = p.select(
        *keys, CHUNK, F.col(point_x).cast("double").alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).cast(row_type).alias("_row"), F.struct(*extra).alias("_point"),
    )
    both = left.unionByName(right)
    if chunks.split:
        both = both.unionByName(_carried(s, p, keys, row, row_type, _struct_of(points, extra)))
    order = piece_window(keys).orderBy("_at", "_side", F.col("_row._i"))
    seen = F.last("_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a point before every sample of its key takes the first one
    first = F.min("_row").over(piece_window(keys))
    out = both.select(*keys, "_point", F.coalesce(seen, first).alias("_row"))
    return out.where(F.col("_point").isNotNull()).select(
        *keys, *[F.col(f"_point.{c}").alias(c) for c in extra], F.col("_row").alias("_hit")
    )


def _struct_of(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[n].dataType, True) for n in names])


def _carried(s, p, keys, row, row_type, point_type) -> DataFrame:
    """The nearest samples of other pieces, put at both ends of each piece."""
    pieces = (
        s.where(F.col(HOT)).select(*keys, CHUNK, row.alias("_row"))
        .unionByName(p.where(F.col(HOT)).select(*keys, CHUNK, F.lit(None).cast(row_type).alias("_row")))
        .groupBy(*keys, CHUNK)
        .agg(F.min("_row").alias("_head"), F.max("_row").alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # a frame that runs to the end is read again for every row; backwards it runs along
    later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.select(
        *keys,
        CHUNK,
        F.last("_tail", ignorenulls=True).over(earlier).alias("_old"),
        F.last("_head", ignorenulls=True).over(later).alias("_new"),
    )
    placed = F.array(
        F.struct(F.lit(float("-inf")).alias("_at"), F.lit(-1).alias("_side"), F.col("_old").alias("_row")),
        F.struct(F.lit(float("inf")).alias("_at"), F.lit(2).alias("_side"), F.col("_new").alias("_row")),
    )
    return (
        ends.select(*keys, CHUNK, F.explode(placed).alias("_e"))
        .select(*keys, CHUNK, "_e._at", "_e._side", "_e._row", F.lit(None).cast(point_type).alias("_point"))
        .where(F.col("_row").isNotNull())
    )
