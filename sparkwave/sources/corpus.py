"""Reading a tree of text files, decoding them, and writing catalogs."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.functions.names import safe_path
from sparkwave.functions.scalar import _c
from sparkwave.plans.lineage import claim, names_in, remove
from sparkwave.plans.sizing import broadcast_if_small

# Where windows-1252 differs from ISO-8859-1.
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def read_corpus(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """``(path, bytes, content)`` of every matching file below ``root``.

    The size limit is pushed to the file listing: larger files are not opened and
    come back without content.
    """
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    if max_bytes is not None:
        large = df.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
        df = df.where(F.col("length") <= max_bytes).select("path", "length", "content").unionByName(large)
    return df.select("path", F.col("length").alias("bytes"), "content")


def decode_text(content) -> Column:
    """Strict UTF-8, and windows-1252 for bytes that are not."""
    c = _c(content)
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(_western(c))


def _western(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, CP1252)), "".join(CP1252.values()))


def read_stretches(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, piece, n, text, more)`` of every matching file below ``root``, as ``lines.stretches`` makes them.

    A file is read in ranges of ``spark.sql.files.maxPartitionBytes``, each in a task of
    its own; ``piece`` is where its range starts. Spark leaves out a byte order mark and
    does not say whether the last line is finished: both follow from the file's size.
    A file with bytes that are not UTF-8 is windows-1252 as a whole. An empty file has no
    rows. ``path`` is a URI; compressed files are not for this reader, since their size
    says nothing of their text.
    """
    read = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    )
    raw = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("value").alias("text"),
    )
    place = F.struct("piece", "n")
    files = raw.groupBy("path").agg(
        (F.max("_size") - F.sum(F.octet_length("text").cast("long") + 1)).alias("_rest"),
        F.bool_and(F.is_valid_utf8("text")).alias("_utf8"),
        F.min(place).alias("_first"),
        F.max(place).alias("_last"),
    )
    finished = F.col("_rest").isin(0, 3)
    rows = raw.join(broadcast_if_small(files), "path")
    mark = F.when((F.col("_rest") >= 2) & (place == F.col("_first")), F.when(F.col("_utf8"), "\ufeff").otherwise("ï»¿")).otherwise("")
    text = F.when(F.col("_utf8"), F.col("text")).otherwise(_western(F.col("text").cast("binary")))
    lines = rows.select(
        "path", "piece", "n", F.concat(mark, text).alias("text"), (finished | (place != F.col("_last"))).alias("more")
    )
    rest = files.where(finished).select(
        "path", "_last.piece", (F.col("_last.n") + 1).alias("n"), F.lit("").alias("text"), F.lit(False).alias("more")
    )
    return lines.unionByName(rest)


def decode_files(files: DataFrame) -> DataFrame:
    """``text`` per file; a file that cannot be used carries ``error`` instead."""
    error = F.when(~safe_path("path"), F.lit("unsafe path")).when(F.col("content").isNull(), F.lit("no content"))
    return files.select("path", F.when(error.isNull(), decode_text("content")).alias("text"), error.alias("error"))


def split_failed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the failures as rows of their own."""
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull()).select("path", "error")


def write_catalog(defs: DataFrame, path: str) -> int:
    """A new version of the definitions by kind, then the numbered manifest that publishes it.

    Readers see the version of the highest number, so a write that breaks off leaves the
    catalog as it was. A number is taken by creating its file, which only one of two
    writers can do; the other takes the next one. Gives the number.
    """
    spark = defs.sparkSession
    version = uuid.uuid4().hex
    where = f"{path}/definitions/version={version}"
    defs.write.partitionBy("kind").parquet(where)
    stored = spark.read.parquet(where)
    catalog_meta(stored).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/meta")
    number = max(_numbers(spark, path), default=0) + 1
    while not claim(spark, f"{path}/manifest/{number}", version):
        number += 1
    return number


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name, _ in names_in(spark, f"{path}/manifest") if name.isdigit())


def _published(spark: SparkSession, path: str) -> str:
    """The version of the highest number; a manifest that broke off while it was made is empty and does not count."""
    for number in reversed(_numbers(spark, path)):
        line = spark.read.text(f"{path}/manifest/{number}").first()
        if line is not None:
            return line["value"]
    raise FileNotFoundError(f"no published catalog in {path}")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Definitions of the newest published version; fails when there is none."""
    return spark.read.parquet(f"{path}/definitions/version={_published(spark, path)}")


def clean_catalog(spark: SparkSession, path: str, older_than_hours: float = 24.0) -> list[str]:
    """Remove versions that are not the published one and that no writer has touched for that long."""
    keep, limit = _published(spark, path), time.time() * 1000 - older_than_hours * 3_600_000
    versions = [(name.removeprefix("version="), changed) for name, changed in names_in(spark, f"{path}/definitions")]
    gone = [v for v, changed in versions if v != keep and changed <= limit]
    for v in gone:
        remove(spark, f"{path}/definitions/version={v}")
    return gone


def catalog_meta(defs: DataFrame) -> DataFrame:
    return defs.agg(
        F.count_distinct("path").alias("files"),
        F.count_distinct("name").alias("names"),
        F.count(F.lit(1)).alias("definitions"),
        F.current_timestamp().alias("installed_at"),
    )


def definition_text(defs: DataFrame, files: DataFrame) -> DataFrame:
    """The verbatim text of every definition, cut from its file."""
    cut = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return defs.join(files.select("path", "text"), "path").select("path", "name", "kind", "line", cut.alias("text"))
