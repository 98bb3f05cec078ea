"""Definitions found in text files: extraction, ranking, search, placeable parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwave.functions import names as N
from sparkwave.functions.scalar import _c
from sparkwave.operators import lines as L
from sparkwave.plans import chunks as C
from sparkwave.plans.lineage import cut, discard

PART_NOTE = "Third-party card, used verbatim and not validated."


# ------------------------------------------------------------------ extraction


def match_blocks(events: DataFrame, keys: Sequence[str] = ("path",), piece: str | None = None) -> DataFrame:
    """Pair openers (``delta`` 1) with closers (-1), innermost first.

    Adds ``depth`` (open blocks after the event), ``close_line`` and
    ``close_end``. Stray closers disappear; openers without a closer keep NULLs.
    Other rows (``delta`` 0) get their depth. Where a file comes in pieces, a piece
    hands on its sum, its lowest point, and its first event of each level.
    """
    here = [*keys, piece] if piece else [*keys]
    walked = C.running_sum(events, keys, ["line"], "_sum", F.col("delta"), piece)
    earlier = F.lit(0)
    if piece:
        lows = C.before_pieces(walked, keys, piece, {"_low": (F.min("_sum"), F.min)})
        walked = walked.join(lows, here)
        earlier = F.least(F.coalesce("_low", F.lit(0)), F.lit(0))
    # a closer with nothing open would push the sum under its lowest point so far
    so_far = Window.partitionBy(*here).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    floor = F.least(F.min("_sum").over(so_far), earlier)
    lowest_before = F.least(
        F.coalesce(F.min("_sum").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), earlier
    )
    walked = walked.withColumn("depth", F.col("_sum") - floor).withColumn(
        "_stray", (F.col("delta") < 0) & (F.col("_sum") < lowest_before)
    )
    level = F.col("depth") + F.when(F.col("delta") < 0, 1).otherwise(0)
    paired = walked.where(~F.col("_stray")).withColumn("_level", F.when(F.col("delta") != 0, level).otherwise(-1))
    same = Window.partitionBy(*here, "_level").orderBy("line")
    after = F.lead(F.struct("line", "end")).over(same)
    if piece:
        first = paired.groupBy(*here, "_level").agg(F.min(F.struct("line", "end")).alias("_first"))
        along = Window.partitionBy(*keys, "_level").orderBy(piece)
        later = first.select(*here, "_level", F.lead("_first").over(along).alias("_later"))
        paired = paired.withColumn("_after", after).join(later, [*here, "_level"])
        after = F.coalesce("_after", "_later")
    opener = F.col("delta") > 0
    return paired.select("*", F.when(opener, after).alias("_close")).select(
        "*", F.col("_close.line").alias("close_line"), F.col("_close.end").alias("close_end")
    ).drop("_sum", "_low", "_stray", "_level", "_after", "_later", "_close")


def extract_definitions(files: DataFrame) -> DataFrame:
    """Every ``.model`` and ``.subckt … .ends`` of ``files(path, text)``.

    Gives name, kind, type, pins, line, character offsets, nesting depth and, for
    models, the parameter text. A block never closed ends with its file.
    """
    sizes = files.select("path", F.length("text").cast("long").alias("_size"))
    return _definitions(L.cards(L.line_offsets(files), L.CATALOG_COMMENTS), sizes)


def stretch_definitions(rows: DataFrame) -> DataFrame:
    """``extract_definitions`` of files that come as stretches (``lines.stretches``, ``corpus.read_stretches``)."""
    lines = L.stretch_lines(rows)
    sizes = lines.groupBy("path").agg(F.max("end").alias("_size"))
    return _definitions(L.cards(lines, L.CATALOG_COMMENTS, piece=L.PIECE), sizes, L.PIECE)


def _definitions(lines: DataFrame, sizes: DataFrame, piece: str | None = None) -> DataFrame:
    bare = F.regexp_replace("text", r"^\s+", "")
    word = F.lower(F.regexp_extract(bare, r"^\.([A-Za-z_]+)", 1))
    is_head = ~F.col("skip") & ~F.col("more")
    # one row per card: its first line, where it ends, and its folded text
    head = F.when(is_head, F.struct("line", "start", "end", *([piece] if piece else []), bare.alias("bare"), word.alias("word")))
    per_card = (
        lines.where(F.col("card") > 0)
        .groupBy("path", "card")
        .agg(
            F.max(head).alias("h"),
            F.max(F.when(~F.col("skip"), F.col("end"))).alias("card_end"),
            L._folded(bare, F.regexp_replace(bare, r"^\+", " "), "").alias("folded"),
        )
        .where(F.col("h.word").isin("subckt", "ends", "eom", "model"))
        .select("path", "h.*", "card_end", "folded")
    )
    delta = F.when(F.col("word") == "subckt", 1).when(F.col("word") == "model", 0).otherwise(-1)
    matched = match_blocks(per_card.withColumn("delta", delta), piece=piece).where(F.col("word").isin("subckt", "model"))

    args = L.tokens(F.regexp_replace("bare", r"^\.[A-Za-z_]+", ""))
    is_model = F.col("word") == "model"
    type_ = F.when(is_model, F.substring_index(F.coalesce(F.get(F.col("_t"), F.lit(1)), F.lit("")), "(", 1)).otherwise("")
    out = matched.withColumn("_t", args).where(F.size("_t") > 0).withColumn("type", type_)
    out = out.join(sizes, "path")
    open_ended = ~is_model & F.col("close_line").isNull()
    return out.select(
        F.lower(F.get("_t", F.lit(0))).alias("name"),
        F.when(is_model, F.lit("model")).otherwise(F.lit("subckt")).alias("kind"),
        "type",
        F.when(is_model, F.array().cast("array<string>")).otherwise(pins_of(F.col("_t"))).alias("pins"),
        "path",
        "line",
        "start",
        F.when(is_model, F.col("card_end")).otherwise(F.coalesce("close_end", "_size")).alias("end"),
        F.when(is_model, F.col("depth")).when(open_ended, 0).otherwise(F.col("depth") - 1).cast("int").alias("depth"),
        open_ended.alias("unterminated"),
        F.when(is_model, model_params(F.col("folded"), F.col("type"))).alias("params"),
    )


def pins_of(toks: Column) -> Column:
    """Tokens after the name, up to ``params:`` or the first ``key=value``."""
    rest = F.slice(toks, 2, F.size(toks))
    stop = lambda t: F.rlike(t, F.lit(r"(?i)^params:?$")) | F.contains(t, F.lit("="))
    return F.filter(rest, lambda t, i: ~F.exists(F.slice(rest, 1, i + 1), stop))


def model_params(card: Column, type_: Column) -> Column:
    """What follows the type token, without comment and outer parentheses."""
    body = F.regexp_replace(card, r";.*$", "")
    front = F.concat(F.lit(r"(?i)^\s*\.model\s+\S+\s*[,\s]\s*\Q"), type_, F.lit(r"\E"))
    rest = F.trim(F.regexp_replace(body, front, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(rest, r"^\(", ""), r"\)$", "")
    return F.trim(F.when(F.startswith(rest, F.lit("(")), inner).otherwise(rest))


# ------------------------------------------------------------------ ranking


def provenance(path, root: str = "models/") -> Column:
    """0 manufacturer, 1 a named category, 2 the scraped set, 3 uncategorized."""
    p = F.lower(_c(path))
    return (
        F.when(F.startswith(p, F.lit(f"{root}manufacturer/")), 0)
        .when(F.startswith(p, F.lit(f"{root}uncategorized/spice_complete/")), 2)
        .when(F.startswith(p, F.lit(f"{root}uncategorized/")), 3)
        .otherwise(1)
    )


def _best_first() -> list[Column]:
    return [provenance("path"), F.when(F.col("kind") == "subckt", 0).otherwise(1), F.col("path"), F.col("line")]


def rank_defs(defs: DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """``rank`` of each definition among those of its name, best source first.

    When some name has more definitions than one task should sort, the table is
    range-partitioned by (name, order), the partition number is frozen with a
    checkpoint, and ranks are counted across partitions.
    """
    return ranked_rows(defs, ["name"], _best_first(), "rank", rows_per_chunk)


def ranked_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str, rows_per_chunk=None) -> DataFrame:
    rows = rows_per_chunk or C.ROWS_PER_CHUNK
    hot = df.groupBy(*keys).count().where(F.col("count") > rows).limit(1).count()
    if not hot:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    placed = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    frozen = cut(placed.withColumn(C.CHUNK, F.spark_partition_id().cast("long")))
    return C.ranked(frozen, keys, order, rank, split=True).drop(C.CHUNK)


def lookup(defs: DataFrame, name: str) -> DataFrame:
    """Definitions of one name, best first."""
    return rank_defs(defs.where(F.col("name") == name.lower()))


def best_defs(defs: DataFrame) -> DataFrame:
    """The best definition of every name, by partial aggregation alone."""
    order = F.struct(*_best_first())
    return defs.groupBy("name").agg(F.min_by(F.struct("kind", "type", "path", "line"), order).alias("d")).select("name", "d.*")


def index_defs(defs: DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """The name index as rows ``(name, rank, kind, path, line)``, not as lists."""
    return rank_defs(defs, rows_per_chunk).select("name", "rank", "kind", "path", "line")


def rank_paths(paths: Column) -> Column:
    """Sort an index entry's paths by provenance, then by name."""
    keyed = F.transform(paths, lambda p: F.struct(provenance(p, root="").alias("c"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def sanitize_index(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop unusable names and paths of ``index(name, paths)``; count entries touched."""
    good = lambda p: p.isNotNull() & (p != "") & ~F.exists(F.split(p, "/"), lambda s: s.isin(".", ".."))
    kept = F.filter("paths", good)
    usable = F.col("name").isNotNull() & F.col("paths").isNotNull()
    marked = index.select("name", F.when(usable, kept).alias("_kept"), F.size("paths").alias("_size"))
    touched = F.col("_kept").isNull() | (F.size("_kept") != F.col("_size"))
    clean = marked.where(F.size("_kept") > 0).select("name", F.col("_kept").alias("paths"))
    return clean, marked.agg(F.count_if(touched).alias("dropped"))


# ------------------------------------------------------------------ search


def search_names(defs: DataFrame, q: str, limit: int = 50, by_length: bool = True) -> DataFrame:
    """Names containing ``q``: exact, then prefix, then the rest; shorter first."""
    q = q.strip().lower()
    found = defs.select(F.lower("name").alias("name")).where(F.contains(F.col("name"), F.lit(q)) & F.lit(q != "")).distinct()
    return _best_hits(found, q, limit, by_length)


def _best_hits(found: DataFrame, q: str, limit: int, by_length: bool) -> DataFrame:
    rank = F.when(F.col("name") == q, 0).when(F.startswith(F.col("name"), F.lit(q)), 1).otherwise(2)
    order = ["rank", *([F.length("name")] if by_length else []), "name"]
    return found.withColumn("rank", rank).orderBy(*order).limit(limit)


#: Letters of a piece, and folders that the pieces are dealt to.
GRAM, GRAM_PARTS = 3, 256


def _gram_part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_PARTS)).cast("int")


def write_name_index(defs: DataFrame, folder: str) -> None:
    """The distinct names, and each three-letter piece with every name that has it, by folders of pieces."""
    names = cut(defs.select(F.lower("name").alias("name")).dropna().distinct())
    names.write.parquet(f"{folder}/names")
    at = F.sequence(F.lit(1), F.length("name") - (GRAM - 1))
    own = F.array_distinct(F.transform(at, lambda p: F.substring(F.col("name"), p, F.lit(GRAM))))
    grams = names.where(F.length("name") >= GRAM).select(F.explode(own).alias("gram"), "name")
    # by piece and name, so that a piece in many names is more than one task
    placed = grams.withColumn("part", _gram_part(F.col("gram"))).repartitionByRange("part", "gram", "name")
    placed.sortWithinPartitions("part", "gram", "name").write.partitionBy("part").parquet(f"{folder}/grams")
    discard(names)


def search_index(spark: SparkSession, folder: str, q: str, limit: int = 50, by_length: bool = True) -> DataFrame:
    """``search_names`` from a written index: only the pieces of ``q`` are read; the hits are then compared whole.

    A query under three letters has no piece and scans the distinct names.
    """
    q = q.strip().lower()
    if len(q) < GRAM:
        return search_names(spark.read.parquet(f"{folder}/names"), q, limit, by_length)
    wanted = sorted({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)})
    index = spark.read.schema("gram string, name string, part int").parquet(f"{folder}/grams")
    mine = index.where(F.col("part").isin(*[_gram_part(F.lit(g)) for g in wanted]) & F.col("gram").isin(wanted))
    met = mine.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted))
    return _best_hits(met.where(F.contains(F.col("name"), F.lit(q))).select("name"), q, limit, by_length)


def search_paths(defs: DataFrame, q: str, limit: int = 50, rows_per_chunk: int | None = None) -> DataFrame:
    """``(name, rank, place, path)``: the hits of ``search_names`` with their paths, best source first."""
    hits = F.broadcast(search_names(defs, q, limit))  # at most ``limit`` rows
    found = defs.select(F.lower("name").alias("name"), "path").join(hits, "name").distinct()
    return ranked_rows(found, ["name"], [provenance("path"), F.col("path")], "place", rows_per_chunk).select("name", "rank", "place", "path")


def search_symbols(symbols: DataFrame, q: str, limit: int = 30) -> DataFrame:
    return search_names(symbols, q, limit, by_length=False)


# ------------------------------------------------------------------ parts


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; later ones are dropped. Partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_row")).select(*keys, "_row.*")


def parts_from_defs(defs: DataFrame, source: str = "library") -> DataFrame:
    """Model definitions that have a symbol, as parts."""
    kind = N.kind_for_model_type("type", "params")
    models = defs.where((F.col("kind") == "model") & (F.coalesce("params", F.lit("")) != "")).withColumn("_kind", kind)
    return models.where(F.col("_kind").isNotNull()).select(
        N.part_id("name", "path", "line").alias("id"),
        N.part_label("name", "path").alias("label"),
        F.col("_kind").alias("kind"),
        F.upper("type").alias("model"),
        "params",
        F.concat(F.lit(f"{source} "), "path", F.lit(" line "), F.col("line").cast("string")).alias("source"),
        F.lit(PART_NOTE).alias("note"),
    )


def register_parts(parts: DataFrame, order: Sequence[Column | str] = ("source",)) -> DataFrame:
    """One part per id, the first registered."""
    return first_wins(parts, ["id"], order)


def parts_for(builtin: DataFrame, library: DataFrame, kind: str) -> DataFrame:
    """Parts of a kind, built-in ones first."""
    both = builtin.withColumn("_lib", F.lit(0)).unionByName(library.withColumn("_lib", F.lit(1)))
    return both.where(F.col("kind") == kind).orderBy("_lib", "id").drop("_lib")


def default_parts(builtin: DataFrame, library: DataFrame) -> DataFrame:
    """The part each kind takes when none is chosen: the first built-in if there is one."""
    both = builtin.withColumn("_lib", F.lit(0)).unionByName(library.withColumn("_lib", F.lit(1)))
    return both.groupBy("kind").agg(F.min_by("id", F.struct("_lib", "id")).alias("id"))


def model_defs_for_parts(catalog: DataFrame) -> DataFrame:
    """Only models with parameters; reads no subcircuit partition and no file text."""
    return catalog.where((F.col("kind") == "model") & (F.col("params") != "")).select("name", "kind", "type", "path", "line", "params")
