import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _texts():
    prose = "the quick brown fox jumps over the lazy dog and runs to the river of gold in the morning with a friend"
    long = " ".join(f"word{k % 997} and{k}" for k in range(30_000))
    other = " ".join(f"tale{k}" for k in range(60))
    near = other.replace("tale5 ", "story ")
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, prose), (5, prose.upper()), (6, prose + " "), (7, prose), (7, prose), (8, prose.replace(" ", "  ")),
        (9, long), (10, long + " end"), (11, other), (12, near), (13, near + " x"), (14, "one two"), (15, "One two"), (16, "a b c d e f"),
        (17, "Ünïcödé 漢字 😀 \x85  x"), (18, "x" * 70_000), (19, "<|endoftext|> <s> idiot </s>"), (20, "\n".join(["same line"] * 30)),
        (None, "no id at all but words"), (None, None), (21, "a\n\nb\r\nA "), (22, "!!! ??? ### $$$ %%%"), (23, "\x00 nul"), (24, "▁ mark ▁▁x"),
        *((k, f"Line {k}\n  COMMON line \nend {k % 3}") for k in range(30, 45)),
        *((k, " ".join(["repeat it now"] * 25)) for k in range(50, 53)),
    ]


@pytest.fixture(scope="session")
def rows():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Every odd case, with extra columns whose names the operators also use inside."""
    wide = [(i, t, "x", 1, i, "f", 2.0, None, 7, "i", "s", 8, 9, 10, "tox", "dot", "row") for i, t in rows]
    schema = (
        "doc_id long, text string, `rid` string, `pos` int, `id` long, `t` string, `score` double, `n` int, group_size int, _id string, "
        "_sha string, _chars int, _d1 int, _d2 int, _toxicity string, `a.b` string, `row` string"
    )
    return spark.createDataFrame(wide, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
