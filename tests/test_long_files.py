"""Files in ranges give what whole files give."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwave.operators import catalog as C, lines as L
from sparkwave.sources import corpus as O

PIECES = [".subckt a p q\n", ".ends\r\n", ".model m D(is=1)\r", "+ n=2\n", "* note\n", "\n", "R1 a b 1\r\n", ".subckt b x", "\r", "\n", ".eom\n", "é€ 𝄞\n"]


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def texts(seed=5, count=30):
    draw = random.Random(seed)
    made = ["".join(draw.choices(PIECES, k=draw.randrange(0, 40))) for _ in range(count)]
    return [*made, "", "\n", "\r", "\r\n", "a\r", "a\r\nb\rc\n\rd"]


@pytest.mark.parametrize("per_piece", [1, 3, 1000])
def test_pieces_equal_whole_files(spark, per_piece):
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts())], "path string, text string").cache()
    cut = L.stretches(files, lines_per_piece=per_piece)
    assert rows(L.stretch_lines(cut).drop("piece")) == rows(L.line_offsets(files))
    assert rows(L.stretch_logical_lines(cut)) == rows(L.logical_lines(files))
    assert rows(C.stretch_definitions(cut)) == rows(C.extract_definitions(files))


def test_reader_in_ranges(spark, tmp_path):
    """Marks, unfinished last lines, old code pages; ranges of a few bytes."""
    for k, t in enumerate(texts(7)):
        raw = t.encode()
        if k % 3 == 1:
            raw = b"\xef\xbb\xbf" + raw if raw else raw
        if k % 3 == 2:
            raw = b"4.7 \xb5F\x80" + raw
        (tmp_path / f"f{k}.lib").write_bytes(raw)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("path")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        found = L.stretch_lines(O.read_stretches(spark, str(tmp_path), "*.lib"))
        assert found.groupBy("path").agg(F.count_distinct("piece").alias("n")).agg(F.max("n")).first()[0] > 3
        got = rows(found.select(name, "line", "text", "start", "end"))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    whole = O.decode_files(O.read_corpus(spark, str(tmp_path), "*.lib").where("bytes > 0").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content"))
    assert got == rows(L.line_offsets(whole))


def test_empty_table(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert C.stretch_definitions(L.stretches(none)).count() == 0
