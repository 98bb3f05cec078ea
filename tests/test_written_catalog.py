"""Publishing in an order, pruned reads, and search by pieces of names."""

import random

from sparkwave.operators import catalog as C
from sparkwave.sources import corpus as O

DEF = "name string, kind string, type string, path string, line int, params string"


def table(spark, names, kind="model"):
    return spark.createDataFrame([(n, kind, "D", "p", k, "is=1") for k, n in enumerate(names)], DEF)


def test_of_two_writers_both_get_a_number(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "c")
    assert O.write_catalog(table(spark, ["a"]), where) == 1
    # the second writer has looked before the first one published
    seen = O._numbers(spark, where)
    assert O.write_catalog(table(spark, ["a", "b"]), where) == 2
    monkeypatch.setattr(O, "_numbers", lambda *a: seen)
    assert O.write_catalog(table(spark, ["a", "b", "c"]), where) == 3
    monkeypatch.undo()
    assert O.read_catalog(spark, where).count() == 3
    # one that broke off between taking its number and writing it
    (tmp_path / "c" / "manifest" / "4").write_text("")
    assert O.read_catalog(spark, where).count() == 3 and O.write_catalog(table(spark, ["z"]), where) == 5


def test_cleaning_leaves_the_published_version(spark, tmp_path):
    where = str(tmp_path / "c")
    for names in (["a"], ["a", "b"]):
        O.write_catalog(table(spark, names), where)
    table(spark, ["half"]).write.parquet(f"{where}/definitions/version=unpublished")
    assert O.clean_catalog(spark, where) == []
    assert len(O.clean_catalog(spark, where, older_than_hours=-1.0)) == 2
    assert O.read_catalog(spark, where).count() == 2


def test_models_are_read_alone(spark, tmp_path):
    where = str(tmp_path / "c")
    O.write_catalog(table(spark, ["a"]).unionByName(table(spark, ["s"], "subckt")), where)
    models = C.model_defs_for_parts(O.read_catalog(spark, where))
    plan = models._jdf.queryExecution().executedPlan().toString()
    assert "(kind" in plan.split("PartitionFilters:")[1].split("]")[0] and [r.name for r in models.collect()] == ["a"]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    draw = random.Random(2)
    names = ["".join(draw.choices("abCé_", k=draw.randrange(0, 9))) for _ in range(300)] + [None, "aaaa", "AAAA"]
    d, where = table(spark, names).cache(), str(tmp_path / "n")
    C.write_name_index(d, where)
    for q in ("abc", "aaa", "a", "", " ÉA", "abcabc", "zzz", "c_a", "aaaa"):
        expected = [tuple(r) for r in C.search_names(d, q, 20).collect()]
        assert [tuple(r) for r in C.search_index(spark, where, q, 20).collect()] == expected, q
    plan = C.search_index(spark, where, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters:")[1].split("]")[0] and "gram" in plan.split("PushedFilters:")[1].split("]")[0]
    C.write_name_index(d.limit(0), str(tmp_path / "e"))
    assert C.search_index(spark, str(tmp_path / "e"), "abc").count() == C.search_index(spark, str(tmp_path / "e"), "a").count() == 0
