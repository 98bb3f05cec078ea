"""Text files as lines and cards.

A file that is one value is a partition of its own. A file that is larger than a task
comes as stretches (``stretches``, or ``sources.corpus.read_stretches``, which reads its
ranges in tasks of their own): then every window runs inside a range, and only one row
per range, its summary, is looked at across the file. Offsets count characters (code
points) of the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwave.functions.scalar import _c, bound
from sparkwave.plans import chunks as C

TERMINATOR = "\r\n|\r|\n"
CATALOG_COMMENTS = ("*", ";")
DECK_COMMENTS = ("*",)
#: Number of the range of a file that a row lies in.
PIECE = "piece"
LINES_PER_PIECE = 1_000_000


def line_offsets(files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(path, line, text, start, end)`` with the real length of each line ending."""
    ends = F.concat(F.regexp_extract_all("text", F.lit(TERMINATOR), 0), F.array(F.lit("")))
    pair = F.arrays_zip(F.split("text", TERMINATOR, -1).alias("piece"), ends.alias("stop"))
    rows = files.select(*keys, F.posexplode(pair).alias("_n", "_p")).select(
        *keys, (F.col("_n") + 1).alias("line"), F.col("_p.piece").alias("text"), F.length("_p.stop").alias("_stop")
    )
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + F.col("_stop")).over(before), F.lit(0)).cast("long")
    return rows.select(*keys, "line", "text", start.alias("start")).select(
        "*", (F.col("start") + F.length("text")).alias("end")
    )


def stretches(files: DataFrame, keys: Sequence[str] = ("path",), lines_per_piece: int = LINES_PER_PIECE) -> DataFrame:
    """``(path, piece, n, text, more)``: what lies between line feeds, in pieces; ``more`` where a line feed follows."""
    parts = F.split("text", "\n", -1)
    rows = files.select(*keys, F.size(parts).alias("_size"), F.posexplode(parts).alias("n", "text"))
    piece = F.floor(F.col("n") / lines_per_piece).cast("long").alias(PIECE)
    return rows.select(*keys, piece, F.col("n").cast("long").alias("n"), "text", (F.col("n") + 1 < F.col("_size")).alias("more"))


def stretch_lines(rows: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``line_offsets`` of files that come as stretches; keeps ``piece``."""
    whole = F.concat("text", F.when(F.col("more"), F.lit("\n")).otherwise(F.lit("")))
    ends = F.concat(F.regexp_extract_all(whole, F.lit(TERMINATOR), 0), F.array(F.lit("")))
    pair = F.arrays_zip(F.split(whole, TERMINATOR, -1).alias("text"), ends.alias("stop"))
    # what follows the line feed at the end of a stretch is the next stretch
    own = F.slice(pair, 1, F.size(pair) - F.col("more").cast("int"))
    split = rows.select(*keys, PIECE, "n", F.posexplode(own).alias("_k", "_p")).select(
        *keys, PIECE, "n", "_k", F.col("_p.text").alias("text"), F.length("_p.stop").alias("_stop")
    )
    size = (F.length("text") + F.col("_stop")).cast("long")
    earlier = C.before_pieces(split, keys, PIECE, {"_lines": (F.count(F.lit(1)), F.sum), "_chars": (F.sum(size), F.sum)})
    here = Window.partitionBy(*keys, PIECE).orderBy("n", "_k")
    upto = F.coalesce(F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.lit(0).cast("long")
    return split.join(earlier, [*keys, PIECE]).select(
        *keys, PIECE,
        (F.row_number().over(here) + F.coalesce("_lines", none)).cast("long").alias("line"),
        "text",
        (upto + F.coalesce("_chars", none)).alias("start"),
    ).select("*", (F.col("start") + F.length("text")).alias("end"))


def is_skippable(text, comments: Sequence[str]) -> Column:
    bare = F.regexp_replace(_c(text), r"^\s+", "")
    return (bare == "") | F.substring(bare, 1, 1).isin(*comments)


def is_continuation(text) -> Column:
    return F.substring(F.regexp_replace(_c(text), r"^\s+", ""), 1, 1) == "+"


def cards(
    lines: DataFrame, comments: Sequence[str], keys: Sequence[str] = ("path",), piece: str | None = None
) -> DataFrame:
    """Lines with the number of the card they belong to (0 before the first).

    Comment and blank lines count to the card above them, also across pieces.
    """
    marked = lines.select("*", is_skippable("text", comments).alias("skip"), is_continuation("text").alias("more"))
    head = ~F.col("skip") & ~F.col("more")
    return C.running_sum(marked, keys, ["line"], "card", head.cast("int"), piece)


def _folded(first: Column, rest: Column, glue: str) -> Column:
    """The lines of one card in order, as one text."""
    piece = F.struct("line", F.when(F.col("more"), rest).otherwise(first).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("skip"), piece)))
    return F.array_join(F.transform(ordered, lambda p: p["piece"]), glue)


def logical_lines(files: DataFrame, comments: Sequence[str] = DECK_COMMENTS, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(path, line, text)``: cards with their ``+`` lines joined by one space.

    A ``+`` line with nothing before it starts a card of its own.
    """
    return _fold_cards(cards(line_offsets(files, keys), comments, keys), keys)


def stretch_logical_lines(
    rows: DataFrame, comments: Sequence[str] = DECK_COMMENTS, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """``logical_lines`` of files that come as stretches."""
    return _fold_cards(cards(stretch_lines(rows, keys), comments, keys, PIECE), keys)


def _fold_cards(carded: DataFrame, keys: Sequence[str]) -> DataFrame:
    kept = carded.where(~F.col("skip"))
    bare = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    rest = F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^\s+", "")
    # card 0 holds leading + lines only; they form one card
    return (
        kept.groupBy(*keys, "card")
        .agg(F.min("line").alias("line"), _folded(bare, rest, " ").alias("text"))
        .drop("card")
    )


def tokens(text) -> Column:
    """Split on blanks and commas; a semicolon ends the card."""
    return F.filter(F.split(F.substring_index(_c(text), ";", 1), r"[\s,]+"), lambda s: s != "")


def _group(levels: int) -> str:
    """A balanced ``{}`` or ``()`` group with that many levels inside it."""
    inner = "[^{}()]*"
    for _ in range(levels):
        inner = r"(?:[^{}()]|[{(]" + inner + r"[})])*"
    return "[{(]" + inner + "[})]"


# quotes and groups stay whole, an unclosed group runs to the end, ; starts a comment
TOKEN = r"(;.*$|(?:'[^']*'?|" + _group(6) + r"|[{(].*$|[})]|[^\s,;'{}()])+)"


def grouped_tokens(text) -> Column:
    """As ``tokens``, with groups kept whole, ``a = b`` glued and ``params:`` dropped."""
    glued = F.regexp_replace(_c(text), r"\s*=\s*", "=")
    return F.filter(
        F.regexp_extract_all(glued, F.lit(TOKEN), 1),
        lambda t: (F.lower(t) != "params:") & ~F.startswith(t, F.lit(";")),
    )


def positional(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~F.rlike(t, F.lit(r"(?s)^[A-Za-z_]\w*=")))


def params_kv(toks: Column) -> Column:
    """``key=value`` tokens as a map with lowered keys; the last of equal keys wins."""
    pairs = F.transform(
        F.filter(toks, lambda t: F.rlike(t, F.lit(r"(?s)^[A-Za-z_]\w*="))),
        lambda t: F.struct(
            F.lower(F.substring_index(t, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(t, r"(?s)^[^=]*=", "")).alias("value"),
        ),
    )
    last = lambda ps: F.filter(
        ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"])
    )
    return F.map_from_entries(bound(pairs, last))


def card_params(text) -> Column:
    """The ``key=value`` map of a whole card, inside its parentheses too."""
    spread = F.regexp_replace(_c(text), r"[()]", " ")
    return params_kv(grouped_tokens(spread))
