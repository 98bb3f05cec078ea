"""Catalog operators: definition rows and library files made from part, text from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwave.operators import catalog as C
from sparkwave.operators import lines as L
from sparkwave.operators import symbols as Y
from sparkwave.plans.lineage import shared_folder
from sparkwave.sources import corpus as O
from sparkwave.functions.names import safe_path
from sparkwave.suite.registry import query, rounded, spread, table


# ------------------------------------------------------------------ definition rows

FOLDERS = ("Models/Manufacturer/", "Models/Diode/", "Models/Uncategorized/spice_complete/", "Models/Uncategorized/")
TYPES = ("D", "NPN", "VDMOS", "D_NAND", "sw")


def defs(spark, sf):
    p = table(spark, sf, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    kind = F.when(F.col("p_size") % 3 == 0, "subckt").otherwise("model")
    return p.select(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"),
        kind.alias("kind"),
        F.when(kind == "model", F.get(F.array(*[F.lit(t) for t in TYPES]), F.col("p_size") % 5)).otherwise("").alias("type"),
        F.concat(F.get(F.array(*[F.lit(f) for f in FOLDERS]), brand % 4), "p_brand").alias("path"),
        F.col("p_partkey").alias("line"),
        F.when(kind == "model", F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("is="), F.col("p_size").cast("string")))).alias("params"),
    )


FOLDER_LIST = ", ".join(f"'{f}'" for f in FOLDERS)
TYPE_LIST = ", ".join(f"'{t}'" for t in TYPES)
DEFS = f"""
WITH d AS (SELECT replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 3 = 0 THEN 'subckt' ELSE 'model' END AS kind,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE list_extract([{TYPE_LIST}], p_size % 5 + 1) END AS type,
  list_extract([{FOLDER_LIST}], CAST(regexp_extract(p_brand, '\\d+') AS INTEGER) % 4 + 1) || p_brand AS path, p_partkey AS line,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '' ELSE 'is=' || p_size END AS params,
  list_extract([0, 1, 2, 3], CAST(regexp_extract(p_brand, '\\d+') AS INTEGER) % 4 + 1) AS class FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY class, kind DESC, path, line) AS rank FROM d)
"""


@query("win13_rank_defs", DEFS + "SELECT name, kind, path, line, rank FROM r")
def win13(spark, sf):
    return C.rank_defs(defs(spark, sf)).select("name", "kind", "path", "line", "rank")


@query("win13_rank_defs_split_names", DEFS + "SELECT name, kind, path, line, rank FROM r")
def win13_split(spark, sf):
    """The same by range partitions, as for names with too many definitions for a task."""
    return C.rank_defs(defs(spark, sf), rows_per_chunk=1).select("name", "kind", "path", "line", "rank")


@query("agg17_index_defs", DEFS + "SELECT name, rank, kind, path, line FROM r")
def agg17(spark, sf):
    return C.index_defs(defs(spark, sf))


@query("cat9_best_defs", DEFS + "SELECT name, kind, type, path, line FROM r WHERE rank = 1")
def cat9(spark, sf):
    return C.best_defs(defs(spark, sf))


@query("cat9_lookup", DEFS + "SELECT kind, path, line, rank FROM r WHERE name = 'red_widget'")
def cat9_lookup(spark, sf):
    return C.lookup(defs(spark, sf), "RED_widget").select("kind", "path", "line", "rank")


PARTS = DEFS + """, p AS (SELECT 'lib:' || name || '@' || path || '#' || line AS id, CASE type WHEN 'D' THEN 'diode' WHEN 'NPN' THEN 'npn' WHEN 'VDMOS' THEN 'nvdmos' WHEN 'sw' THEN 'sw' END AS kind,
  upper(type) AS model, params, 'library ' || path || ' line ' || line AS source FROM d WHERE kind = 'model' AND params <> '')
"""


@query("cat7_parts_from_defs", PARTS + "SELECT id, kind, model, params, source FROM p WHERE kind IS NOT NULL")
def cat7(spark, sf):
    return C.parts_from_defs(defs(spark, sf)).select("id", "kind", "model", "params", "source")


@query("cat8_register_parts", PARTS + "SELECT id, kind, source FROM p WHERE kind IS NOT NULL")
def cat8(spark, sf):
    """Registering the same parts twice adds nothing."""
    p = C.parts_from_defs(defs(spark, sf))
    return C.register_parts(p.unionByName(p)).select("id", "kind", "source")


@query("cat10_model_defs_for_parts", DEFS + "SELECT name, type, path, line, params FROM d WHERE kind = 'model' AND params <> ''")
def cat10(spark, sf):
    return C.model_defs_for_parts(defs(spark, sf)).select("name", "type", "path", "line", "params")


@query("cat10_written_catalog", DEFS + "SELECT name, type, path, line, params FROM d WHERE kind = 'model' AND params <> ''")
def cat10_written(spark, sf):
    """From the catalog as written: only the folder of models is read."""
    where = shared_folder(spark, "catalog")
    O.write_catalog(defs(spark, sf), where)
    return C.model_defs_for_parts(O.read_catalog(spark, where)).select("name", "type", "path", "line", "params")


@query(
    "set3_default_parts",
    PARTS + """, q AS (SELECT 'B' || s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'diode' ELSE 'npn' END AS kind, 0 AS lib FROM supplier UNION ALL SELECT id, kind, 1 FROM p WHERE kind IS NOT NULL)
    SELECT kind, arg_min(id, (lib, id)) AS id FROM q GROUP BY kind""",
)
def set3(spark, sf):
    own = table(spark, sf, "supplier").select(
        F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "diode").otherwise("npn").alias("kind")
    )
    return C.default_parts(own, C.parts_from_defs(defs(spark, sf)).select("id", "kind"))


@query(
    "join12_first_wins",
    "SELECT p_name, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey, min(p_size) AS p_size FROM part GROUP BY p_name",
)
def join12(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_partkey", "p_size")
    return C.first_wins(p, ["p_name"], ["p_size", "p_partkey"])


SEARCH = """
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part WHERE contains(p_name, 'g')),
r AS (SELECT name, CASE WHEN name = 'g' THEN 0 WHEN starts_with(name, 'g') THEN 1 ELSE 2 END AS rank FROM n)
"""


@query("top1_search_names", SEARCH + "SELECT name, CAST(rank AS INTEGER) AS rank FROM r ORDER BY rank, length(name), name LIMIT 10")
def top1(spark, sf):
    return C.search_names(defs(spark, sf), " G ", 10)


@query(
    "top1_search_paths",
    DEFS + """, n AS (SELECT DISTINCT name FROM d WHERE contains(name, 'g')),
    q AS (SELECT name, CAST(CASE WHEN name = 'g' THEN 0 WHEN starts_with(name, 'g') THEN 1 ELSE 2 END AS INTEGER) AS rank FROM n ORDER BY rank, length(name), name LIMIT 10)
    SELECT name, q.rank, row_number() OVER (PARTITION BY name ORDER BY class, path) AS place, path FROM q JOIN (SELECT DISTINCT name, path, class FROM d) USING (name)""",
)
def top1_paths(spark, sf):
    return C.search_paths(defs(spark, sf), " G ", 10)


@query("top2_search_symbols", SEARCH + "SELECT name, CAST(rank AS INTEGER) AS rank FROM r ORDER BY rank, name LIMIT 12")
def top2(spark, sf):
    return C.search_symbols(defs(spark, sf), "g", 12)


LONGER = SEARCH.replace("'g'", "'dge'")


@query("top1_search_index", LONGER + "SELECT name, CAST(rank AS INTEGER) AS rank FROM r ORDER BY rank, length(name), name LIMIT 10")
def top1_index(spark, sf):
    """Only the three-letter pieces of the query are read."""
    where = shared_folder(spark, "names")
    C.write_name_index(defs(spark, sf), where)
    return C.search_index(spark, where, " DGE", 10)


@query("top2_search_index", SEARCH + "SELECT name, CAST(rank AS INTEGER) AS rank FROM r ORDER BY rank, name LIMIT 12")
def top2_index(spark, sf):
    """A query of one letter, which has no piece."""
    where = shared_folder(spark, "names")
    C.write_name_index(defs(spark, sf), where)
    return C.search_index(spark, where, "g", 12, by_length=False)


@query("top1_blank_query", "SELECT CAST(0 AS BIGINT) AS n")
def top1_blank(spark, sf):
    """A blank query finds nothing; counted so that a row comes back."""
    return C.search_names(defs(spark, sf), "  ").agg(F.count(F.lit(1)).alias("n"))


INDEX = """
WITH i AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name || p_partkey END AS name,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE ['Uncategorized/' || p_brand, CASE WHEN p_size % 5 = 0 THEN '../x' ELSE 'Manufacturer/' || p_type END, 'Diode/' || p_size] END AS paths FROM part)
"""


def index(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.when(F.col("p_size") % 10 != 0, F.concat("p_name", F.col("p_partkey").cast("string"))).alias("name"),
        F.when(
            F.col("p_size") % 9 != 0,
            F.array(
                F.concat(F.lit("Uncategorized/"), "p_brand"),
                F.when(F.col("p_size") % 5 == 0, "../x").otherwise(F.concat(F.lit("Manufacturer/"), "p_type")),
                F.concat(F.lit("Diode/"), F.col("p_size").cast("string")),
            ),
        ).alias("paths"),
    )


@query(
    "flt3_sanitize_index_win14_rank_paths",
    INDEX + """SELECT name, CASE WHEN paths[2] = '../x' THEN '' ELSE paths[2] || '|' END || paths[3] || '|' || paths[1] AS paths FROM i WHERE name IS NOT NULL AND paths IS NOT NULL""",
)
def flt3(spark, sf):
    clean, _ = C.sanitize_index(index(spark, sf))
    return clean.select("name", F.array_join(C.rank_paths(F.col("paths")), "|").alias("paths"))


@query("flt3_sanitize_index_dropped", INDEX + "SELECT count(*) FILTER (name IS NULL OR paths IS NULL OR paths[2] = '../x') AS dropped FROM i")
def flt3_dropped(spark, sf):
    return C.sanitize_index(index(spark, sf))[1]


@query("snk2_catalog_meta", DEFS + "SELECT count(DISTINCT path) AS files, count(DISTINCT name) AS names, count(*) AS definitions FROM d")
def snk2(spark, sf):
    return O.catalog_meta(defs(spark, sf)).drop("installed_at")


@query("snk1_write_catalog", DEFS + "SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM d GROUP BY kind")
def snk1(spark, sf):
    where = shared_folder(spark, "catalog")
    O.write_catalog(defs(spark, sf), where)
    return O.read_catalog(spark, where).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query("set1_union_defs", DEFS + "SELECT kind, count(*) * 2 AS n FROM d GROUP BY kind")
def set1(spark, sf):
    d = defs(spark, sf)
    return d.unionByName(d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ library files

CR, LF = "\r", "\n"


def library_files(spark, sf):
    """Ten parts to a file: models with CRLF, blocks, nested models, stray closers, open blocks."""
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    say = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    form = F.col("p_partkey") % 5
    piece = (
        F.when(form == 0, say(".MODEL m", k, " D(IS=", size, "E-14, RS=1)", CR + LF, "* note", CR + LF, "+ N=2", CR + LF))
        .when(form == 1, say(".subckt s", k, " a b params: r=", size, LF, "R1 a b {r}", LF, ".ends", LF))
        .when(form == 2, say(".subckt o", k, " in, out", LF, ".model Q", k, " NPN bf=", size, " ; c", LF, ".ends o", k, LF))
        .when(form == 3, F.lit(".ends" + LF + "; comment" + LF))
        .otherwise(say(".subckt u", k, " p q", LF))
    )
    rows = p.select(F.floor(F.col("p_partkey") / 10).alias("_f"), F.struct("p_partkey", piece.alias("piece")).alias("_s"))
    texts = rows.groupBy("_f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["piece"]), "").alias("text"))
    return texts.select(F.concat(F.lit("lib/"), F.col("_f").cast("string")).alias("path"), "text")


PIECES = """
WITH p AS (SELECT p_partkey AS k, 'lib/' || p_partkey // 10 AS path, p_partkey % 10 AS pos, p_partkey % 5 AS form, p_size AS size FROM part),
q AS (SELECT *, CASE form WHEN 0 THEN '.MODEL m' || k || ' D(IS=' || size || 'E-14, RS=1)' || chr(13) || chr(10) || '* note' || chr(13) || chr(10) || '+ N=2' || chr(13) || chr(10)
    WHEN 1 THEN '.subckt s' || k || ' a b params: r=' || size || chr(10) || 'R1 a b {r}' || chr(10) || '.ends' || chr(10)
    WHEN 2 THEN '.subckt o' || k || ' in, out' || chr(10) || '.model Q' || k || ' NPN bf=' || size || ' ; c' || chr(10) || '.ends o' || k || chr(10)
    WHEN 3 THEN '.ends' || chr(10) || '; comment' || chr(10) ELSE '.subckt u' || k || ' p q' || chr(10) END AS piece,
    CASE form WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 3 END AS n FROM p),
o AS (SELECT *, coalesce(sum(length(piece)) OVER w, 0) AS off, coalesce(sum(n) OVER w, 0) AS before, sum(length(piece)) OVER (PARTITION BY path) AS total,
      CASE WHEN pos IN (5, 6, 7) THEN 1 ELSE 0 END AS base FROM q WINDOW w AS (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT path, off + 5 AS close_end FROM o WHERE pos = 8),
d AS (
  SELECT 'm' || k AS name, 'model' AS kind, 'D' AS type, '' AS pins, path, before + 1 AS line, off AS start, off + length(piece) - 2 AS "end", base AS depth, FALSE AS unterminated, 'IS=' || size || 'E-14, RS=1)  N=2' AS params FROM o WHERE form = 0
  UNION ALL SELECT 's' || k, 'subckt', '', 'a b', path, before + 1, off, off + length(piece) - 1, base, FALSE, NULL FROM o WHERE form = 1
  UNION ALL SELECT 'o' || k, 'subckt', '', 'in out', path, before + 1, off, off + length(piece) - 1, base, FALSE, NULL FROM o WHERE form = 2
  UNION ALL SELECT 'q' || k, 'model', 'NPN', '', path, before + 2, off + length('.subckt o' || k || ' in, out') + 1, off + length('.subckt o' || k || ' in, out') + 1 + length('.model Q' || k || ' NPN bf=' || size || ' ; c'), base + 1, FALSE, 'bf=' || size FROM o WHERE form = 2
  UNION ALL SELECT 'u' || o.k, 'subckt', '', 'p q', o.path, before + 1, off, CASE WHEN pos = 4 THEN c.close_end ELSE total END, 0, pos = 9, NULL FROM o JOIN c USING (path) WHERE form = 4)
"""


CAT1 = PIECES + """SELECT name, kind, type, pins, path, CAST(line AS INTEGER) AS line, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(depth AS INTEGER) AS depth, unterminated, params FROM d"""


@query("cat1_extract_definitions", CAT1)
def cat1(spark, sf):
    return C.extract_definitions(library_files(spark, sf)).withColumn("pins", F.array_join("pins", " "))


@query("cat1_extract_definitions_split", CAT1)
def cat1_split(spark, sf):
    """The same with ranges of three lines, as for files too large for a task."""
    rows = L.stretches(library_files(spark, sf), lines_per_piece=3)
    return C.stretch_definitions(rows).withColumn("pins", F.array_join("pins", " "))


@query("cat2_card_extent", PIECES + "SELECT path, name, CAST(line AS INTEGER) AS line, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM d WHERE kind = 'model'")
def cat2(spark, sf):
    return C.extract_definitions(library_files(spark, sf)).where("kind = 'model'").select("path", "name", "line", "start", "end")


@query("cat3_pins", PIECES + "SELECT name, unnest(string_split(pins, ' ')) AS pin FROM d WHERE kind = 'subckt'")
def cat3(spark, sf):
    return C.extract_definitions(library_files(spark, sf)).where("kind = 'subckt'").select("name", F.explode("pins").alias("pin"))


@query("cat4_model_params", PIECES + "SELECT name, params FROM d WHERE kind = 'model'")
def cat4(spark, sf):
    return C.extract_definitions(library_files(spark, sf)).where("kind = 'model'").select("name", "params")


WIN11 = PIECES + "SELECT path, CAST(line AS INTEGER) AS line, CAST(depth AS INTEGER) AS depth, unterminated FROM d WHERE kind = 'subckt'"


@query("win11_match_blocks", WIN11)
def win11(spark, sf):
    return C.extract_definitions(library_files(spark, sf)).where("kind = 'subckt'").select("path", "line", "depth", "unterminated")


@query("win11_match_blocks_split", WIN11)
def win11_split(spark, sf):
    rows = L.stretches(library_files(spark, sf), lines_per_piece=2)
    return C.stretch_definitions(rows).where("kind = 'subckt'").select("path", "line", "depth", "unterminated")


@query(
    "snk3_definition_text",
    PIECES + """, f AS (SELECT path, string_agg(piece, '' ORDER BY k) AS text FROM o GROUP BY path)
    SELECT d.path, d.name, substr(f.text, CAST(d.start AS BIGINT) + 1, CAST(d."end" - d.start AS BIGINT)) AS text FROM d JOIN f USING (path)""",
)
def snk3(spark, sf):
    files = library_files(spark, sf)
    return O.definition_text(C.extract_definitions(files), files).select("path", "name", "text")


WIN10 = PIECES + """, l AS (SELECT path, before, '.MODEL m' || k || ' D(IS=' || size || 'E-14, RS=1) N=2' AS text, 1 AS n FROM o WHERE form = 0
      UNION ALL SELECT path, before, unnest(['.subckt s' || k || ' a b params: r=' || size, 'R1 a b {r}', '.ends']), unnest([1, 2, 3]) FROM o WHERE form = 1
      UNION ALL SELECT path, before, unnest(['.subckt o' || k || ' in, out', '.model Q' || k || ' NPN bf=' || size || ' ; c', '.ends o' || k]), unnest([1, 2, 3]) FROM o WHERE form = 2
      UNION ALL SELECT path, before, unnest(['.ends', '; comment']), unnest([1, 2]) FROM o WHERE form = 3
      UNION ALL SELECT path, before, '.subckt u' || k || ' p q', 1 FROM o WHERE form = 4)
    SELECT path, CAST(before + n AS INTEGER) AS line, text FROM l"""


@query("win10_logical_lines", WIN10)
def win10(spark, sf):
    return L.logical_lines(library_files(spark, sf))


@query("win10_logical_lines_split", WIN10)
def win10_split(spark, sf):
    return L.stretch_logical_lines(L.stretches(library_files(spark, sf), lines_per_piece=2))


@query(
    "cat5_tokens",
    """SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, t AS token FROM (SELECT p_partkey, unnest([p_type, p_brand, 'x=' || p_size]) AS t, unnest([1, 2, 3]) AS i FROM part)""",
)
def cat5(spark, sf):
    text = F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",x="), F.col("p_size").cast("string"), F.lit(" ; "), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.posexplode(L.tokens(text)).alias("pos", "token"))


@query(
    "cat6_params_kv",
    """SELECT p_partkey, unnest(['is', 'rs', 'n']) AS key, unnest([p_size || 'e-14', '{2*x}', '3']) AS value FROM part""",
)
def cat6(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit(".model D1 D (IS = "), size, F.lit("e-14, N=2 rs={2*x} n=3)"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", F.explode(L.card_params(text)).alias("key", "value"))


# ------------------------------------------------------------------ whole documents


WIN12 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    o AS (SELECT *, coalesce(sum(length(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
    SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(start AS BIGINT) AS start, CAST(start + length(line_text) AS BIGINT) AS "end", md5(line_text) AS digest FROM o"""


@query("win12_line_offsets", WIN12)
def win12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return L.line_offsets(d, ["doc_id"]).select("doc_id", "line", "start", "end", F.md5("text").alias("digest"))


@query("win12_line_offsets_split", WIN12)
def win12_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lines = L.stretch_lines(L.stretches(d, ["doc_id"], 2), ["doc_id"])
    return lines.select("doc_id", "line", "start", "end", F.md5("text").alias("digest"))


@query("src5_decode_utf8", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def src5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", O.decode_text(F.encode("text", "UTF-8")).alias("text"))
    return d.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("src5_decode_western", "SELECT p_partkey, p_size || 'µF €' || p_name AS text FROM part")
def src5_western(spark, sf):
    raw = F.concat(F.encode(F.col("p_size").cast("string"), "UTF-8"), F.unhex(F.lit("B5462080")), F.encode("p_name", "UTF-8"))
    return table(spark, sf, "part").select("p_partkey", O.decode_text(raw).alias("text"))


def _document_files(spark, sf):
    d = table(spark, sf, "documents")
    folder = F.when(F.col("lang") == "fr", F.concat(F.lit("../"), "source")).otherwise(F.col("source"))
    body = F.when(F.col("lang") != "de", F.encode("text", "UTF-8"))
    return d.select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string")).alias("path"), body.alias("content"))


@query("src6_failed_files", """SELECT CASE WHEN lang = 'fr' THEN '../' ELSE '' END || source || '/' || doc_id AS path, CASE WHEN lang = 'fr' THEN 'unsafe path' ELSE 'no content' END AS error FROM documents WHERE lang IN ('fr', 'de')""")
def src6(spark, sf):
    return O.split_failed(O.decode_files(_document_files(spark, sf)))[1]


@query("src6_readable_files", "SELECT source || '/' || doc_id AS path, md5(text) AS digest FROM documents WHERE lang NOT IN ('fr', 'de')")
def src6_ok(spark, sf):
    return O.split_failed(O.decode_files(_document_files(spark, sf)))[0].select("path", F.md5("text").alias("digest"))


@query("src7_safe_path", "SELECT p_partkey, p_size % 4 >= 2 AS safe FROM part")
def src7(spark, sf):
    k = F.col("p_size") % 4
    path = F.when(k == 0, F.concat("p_type", F.lit("/../"), "p_brand")).when(k == 1, "//").otherwise(F.concat(F.lit("/"), "p_type", F.lit("/..a/"), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", safe_path(path).alias("safe"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("src4_read_corpus", "SELECT t || '.parquet' AS file, TRUE AS filled FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") v(t)")
def src4(spark, sf):
    """The table files themselves, found by pattern; content is not read."""
    files = O.read_corpus(spark, sf, "*.parquet").select("path", "bytes")
    name = F.regexp_extract("path", r"(\w+\.parquet)(/[^/]+)?$", 1)
    return files.groupBy(name.alias("file")).agg((F.sum("bytes") > 0).alias("filled"))


@query(
    "src4_read_stretches",
    """SELECT source, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(('0x' || substr(md5(line), 1, 8))::BIGINT) AS BIGINT) AS digest
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY source""",
)
def src4_stretches(spark, sf):
    """Documents written as text files, read back in ranges of files."""
    where = shared_folder(spark, "texts")
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    d.select(F.col("source").alias("folder"), "text").write.partitionBy("folder").text(where)
    lines = L.stretch_lines(O.read_stretches(spark, where, "part-*")).where(F.col("text") != "")
    digest = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")
    return lines.groupBy(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(digest).alias("digest")
    )


# ------------------------------------------------------------------ symbol files


def symbol_files(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    say = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    piece = say(
        "# part\nDEF P", k, " U 0 40 Y Y 2 L N\nALIAS A", k, " P0\nDRAW\nS -", size, " -10 ", size, " 20 0 1 0 N\n",
        "X IN 2 -100 ", size, " 50 R 50 50 1 1 I\nX ~ 1 100 0 50 L 50 50 0 1 O\nX alt 3 0 0 50 U 50 50 2 1 P\nT ignored\nENDDRAW\nENDDEF\n",
    )
    rows = p.select(F.floor(F.col("p_partkey") / 10).alias("_f"), F.struct("p_partkey", piece.alias("piece")).alias("_s"))
    texts = rows.groupBy("_f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["piece"]), "").alias("text"))
    return texts.select(F.concat(F.lit("sym/"), F.col("_f").cast("string")).alias("path"), "text")


SYMBOLS = """
WITH n AS (SELECT 'sym/' || p_partkey // 10 AS path, 'P' || p_partkey AS name, p_size AS size FROM part
  UNION ALL SELECT 'sym/' || p_partkey // 10, 'A' || p_partkey, p_size FROM part
  UNION ALL SELECT 'sym/' || p_partkey // 10, 'P0', arg_min(p_size, p_partkey) FROM part WHERE p_partkey >= 10 GROUP BY 1)
"""


@query("cat11_extract_symbols", SYMBOLS + "SELECT path, lower(name) AS key, name, 'U' AS ref, CAST(2 AS INTEGER) AS units, CAST(2 AS INTEGER) AS pins, CAST(1 AS INTEGER) AS shapes, CAST(size AS DOUBLE) AS x2 FROM n")
def cat11(spark, sf):
    y = Y.extract_symbols(symbol_files(spark, sf))
    return y.select("path", "key", "name", "ref", "units", F.size("pins").alias("pins"), F.size("shapes").alias("shapes"), F.get("shapes", F.lit(0))["x2"].alias("x2"))


@query(
    "cat12_symbol_pins",
    SYMBOLS + """SELECT path, lower(name) AS key, unnest([0, 1]) AS index, unnest(['1', 'IN']) AS pin, unnest([CAST(20 AS DOUBLE), -20]) AS x, unnest([CAST(0 AS DOUBLE), round(-0.2 * size, 6)]) AS y FROM n""",
)
def cat12(spark, sf):
    y = Y.symbol_pins(Y.extract_symbols(symbol_files(spark, sf)))
    return y.select("path", "key", "index", F.col("name").alias("pin"), rounded("x"), rounded("y"))


@query(
    "cat13_symbol_bounds",
    SYMBOLS + """SELECT path, lower(name) AS key, -20.0 AS x1, round(least(-4.0, -0.2 * size), 6) AS y1, 20.0 AS x2, 2.0 AS y2 FROM n""",
)
def cat13(spark, sf):
    y = Y.symbol_bounds(Y.extract_symbols(symbol_files(spark, sf)))
    return y.select("path", "key", *[rounded(c) for c in ("x1", "y1", "x2", "y2")])
