"""Queries of the text operators over the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.llm import (
    ball_search,
    byte_bpe,
    exact_dedup,
    jaccard_join,
    line_dedup,
    packing,
    periodic_runs,
    piece_bpe,
    quality_classifier,
    quality_rules,
    token_counts,
    toxicity,
    url_filter,
)
from sparkwave.llm.common import let, text_of, words_of
from sparkwave.suite.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS chars,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents")).drop("chars")


TOKEN_LIMIT = 1024


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).select("doc_id", "toxicity.*").withColumnRenamed("rejected", "toxic")


@query("op4_piece_bpe")
def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "agrees",
    )


def held_out(id: str = "doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality_classifier.score(docs, model)
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query(
    "op6_line_dedup",
    r"""
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM t),
    k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
    GROUP BY doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.fit(pages))
    return judged.select("page_id", *[F.col("filter")[f].alias(f) for f in ("host", "path", "rule", "verdict")])


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_RATIO = "(CASE WHEN {d} > 0 THEN {n}::DOUBLE / {d} ELSE 0 END)"
_BROKEN = " OR ".join(
    f"{_RATIO.format(n=r.numerator, d=r.denominator)} {sign} {limit}"
    for r in quality_rules.RULES
    for sign, limit in (("<", r.low), (">", r.high))
    if limit is not None
)


@query(
    "op8_quality_rules",
    rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    wins AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
             FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
    cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
    c AS (
      SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
             len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN cover USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR {_BROKEN}) AS kept
    FROM b
    """,
)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query(
    "op12_ball_search",
    r"""
    WITH d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents),
    t AS (SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM d GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
          FROM (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark)),
    n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
    c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
    m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM n, c),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, n_docs),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
          FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    WHERE rank <= 50
    """,
)
def op12_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def repeated_tail(id: str = "doc_id", text: str = "text"):
    """The words of a text; in one document of ten (by the id's checksum) the words from some place on repeat with some period."""
    code = F.coalesce(F.crc32(F.col(id).cast("string")), F.lit(1))

    def tail(words):
        n, g = F.size(words), F.floor(code / 10)
        from_ = (g % n).cast("int")
        period = (1 + F.floor((n - from_) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, from_ + 1, period), F.ceil((n - from_) / period).cast("int")))
        return F.concat(F.slice(words, F.lit(1), from_), F.slice(again, F.lit(1), n - from_))

    return let(words_of(text_of(text)), lambda w: F.when((code % 10 == 0) & (F.size(w) > 0), tail(w)).otherwise(w))


@query(
    "op13_periodic_runs",
    r"""
    WITH steps AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS step
      FROM range(256) r(b)),
    d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS name FROM documents),
    h AS (SELECT doc_id, w, len(w) AS n,
                 xor(4294967295, list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
                                             lambda c, x: xor(c >> 8, step[1 + (xor(c, x) & 255)]), 4294967295)) AS h
          FROM d, steps),
    a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
    p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
    e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
                   list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM p),
    g AS (SELECT doc_id, n, i, hash(w[i + 1:i + 16]) AS gram FROM (SELECT *, unnest(range(n - 15)) AS i FROM e WHERE n >= 24)),
    m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    s AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length
          FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM m) GROUP BY doc_id, q, part),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
    b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
                 first(struct_pack(start, length, period) ORDER BY length::DOUBLE / period DESC, start, period) AS best
          FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
          FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM e) x
          WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length)
          GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
           1000 * best.length // best.period AS exponent_milli,
           sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(table(spark, sf_dir, "documents"), words=repeated_tail())
    # lengths and periods are below 2^26, so that equal quotients are equal doubles and others differ
    by_size = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    best = F.get(F.array_sort(by_size), F.lit(0))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
