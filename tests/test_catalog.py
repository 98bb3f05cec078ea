"""Hand-written library, symbol and deck texts."""

from pyspark.sql import functions as F

from sparkwave.functions import grids as G
from sparkwave.functions import scalar as X
from sparkwave.operators import catalog as C, hierarchy as H, symbols as Y, triage as T
from sparkwave.sources import corpus as O

LIB = (
    "* head\r\n.MODEL D1 D(IS=1E-12, RS=14.61K)\r\n* c\n+ N=2 ; x\n.model q2 NPN bf=100\r.subckt outer a b params: r=1\n.subckt in1 x y\n"
    ".model m NMOS(kp=1)\n.ends\n.ends\n.ends\n.subckt in2 p q r=2\nR1 p q 1\n.eom\n.subckt lost a"
)


def test_blocks_extents_and_slices(spark):
    files = spark.createDataFrame([("Models/a.lib", LIB)], "path string, text string")
    d = C.extract_definitions(files).cache()
    got = {r.name: r for r in d.collect()}
    assert {n: (r.line, r.depth, r.unterminated) for n, r in got.items()} == {
        "d1": (2, 0, False), "q2": (5, 0, False), "outer": (6, 0, False), "in1": (7, 1, False), "m": (8, 2, False),
        "in2": (12, 0, False), "lost": (15, 0, True),
    }
    assert got["outer"].pins == ["a", "b"] and got["in2"].pins == ["p", "q"]
    assert (got["d1"].type, got["q2"].params, got["m"].params) == ("D", "bf=100", "kp=1")
    text = {r["name"]: r["text"] for r in O.definition_text(d, files).collect()}
    assert text["d1"] == ".MODEL D1 D(IS=1E-12, RS=14.61K)\r\n* c\n+ N=2 ; x"
    assert text["in2"] == ".subckt in2 p q r=2\nR1 p q 1\n.eom"


def test_crlf_offsets(spark):
    text = "\r\n".join(f".model d{k} D(is={k})" for k in range(40))
    files = spark.createDataFrame([("a", text)], "path string, text string")
    got = O.definition_text(C.extract_definitions(files), files).collect()
    assert sorted(r["text"] for r in got) == sorted(text.split("\r\n"))


def test_symbols(spark):
    text = (
        "DEF TL U 0 40 Y Y 2 L N\nALIAS TB\nDRAW\nS -10 -10 10 20 0 1 0 N\nX + 3 -100 50 20 R 50 50 1 1 I\nX ~ 1 100 0 20 L 50 50 0 1 I\n"
        "X - 6 0 0 20 L 50 50 2 1 I\nT x\nENDDRAW\nENDDEF\nDEF bad U\nDRAW\nDEF ok R\nDRAW\nENDDRAW\nENDDEF"
    )
    y = Y.extract_symbols(spark.createDataFrame([("s", text)], "path string, text string")).cache()
    assert sorted(r.key for r in y.collect()) == ["ok", "tb", "tl"]
    pins = [(r["name"], r["x"], r["y"]) for r in Y.symbol_pins(y).where("key = 'tl'").orderBy("index").collect()]
    assert pins == [("1", 20.0, 0.0), ("+", -20.0, -10.0)]
    box = {r.key: (r.x1, r.y1, r.x2, r.y2) for r in Y.symbol_bounds(y).collect()}
    assert box["ok"] == (-20.0, -20.0, 20.0, 20.0) and box["tl"] == (-20.0, -10.0, 20.0, 2.0)


def test_hierarchy_and_recursion(spark):
    decks = [
        ("h", "t\n.subckt outer a b\nX1 a m inner\nR2 m b 1\n.subckt inner p q\nR1 p q 1\nR3 p n 2\n.ends\n.ends\nX9 in 0 outer\nX8 in gnd outer"),
        ("r", "t\n.subckt a p\nX1 p a\n.ends\nX0 1 a"),
    ]
    cards = T.deck_cards(spark.createDataFrame(decks, "deck string, text string")).cache()
    flat = H.expand_hierarchy(T.elements(cards), T.definitions(cards))
    got = {r.name: r.nodes for r in flat.elements.collect()}
    assert got["X9.X1.R1"] == ["in", "X9.m"] and got["X8.X1.R3"] == ["in", "X8.X1.n"] and got["X9.R2"] == ["X9.m", "0"]
    assert len(got) == 6
    assert [(r.deck, r.error) for r in flat.errors.collect()] == [("r", "nested too deep")]


def test_numbers_and_grids(spark):
    row = spark.range(1).select(
        *[X.eng_parse(F.lit(t)).alias(f"c{n}") for n, t in enumerate(["470u", "470µF", "2meg", "1mil", "1e3ohm", "x1", "-.5k"])],
        G.grid_log("dec", F.lit(1), F.lit(1), F.lit(50)).alias("log"), G.grid_range(F.lit(0), F.lit(3), F.lit(0.1)).alias("lin"),
        X.eng_format(F.lit(0.00047), "F").alias("f"), X.eng_format(F.lit(1.5e-17)).alias("e"),
    ).first()
    assert [row[f"c{n}"] for n in range(7)] == [470e-6, 470e-6, 2e6, 25.4e-6, 1000.0, None, -500.0]
    assert [round(v, 9) for v in row["log"]] == [1, 10, 100] and len(row["lin"]) == 31
    assert (row["f"], row["e"]) == ("470.0 uF", "1.50e-17")


def test_catalog_is_complete_only_with_meta(spark, tmp_path):
    d = spark.createDataFrame([("a", "model", "p", 1), ("b", "subckt", "p", 2)], "name string, kind string, path string, line int")
    O.write_catalog(d, str(tmp_path / "c"))
    assert O.read_catalog(spark, str(tmp_path / "c")).count() == 2
    meta = spark.read.parquet(str(tmp_path / "c" / "meta")).first()
    assert (meta.files, meta.names, meta.definitions) == (1, 2, 2)


def test_interrupted_rewrite_leaves_the_catalog(spark, tmp_path, monkeypatch):
    import pytest

    where = str(tmp_path / "c")
    d = spark.createDataFrame([("a", "model", "p", 1), ("b", "subckt", "p", 2)], "name string, kind string, path string, line int")
    O.write_catalog(d, where)

    def broken(defs):
        raise RuntimeError("stopped before the meta row")

    monkeypatch.setattr(O, "catalog_meta", broken)
    with pytest.raises(RuntimeError):
        O.write_catalog(d.limit(1), where)
    monkeypatch.undo()
    assert O.read_catalog(spark, where).count() == 2
    O.write_catalog(d.limit(1), where)
    assert O.read_catalog(spark, where).count() == 1


def test_parameters_through_the_levels(spark):
    """An override by the caller's name, a default in its place, an unreadable one, and a parameter of the deck."""
    none = {}
    cards = [
        ("d", "", 1, "x", "X1", ["in", "mid"], ["outer"], {"scale": "3k"}),
        ("d", "", 2, "x", "X2", ["in", "mid"], ["outer"], none),
        ("d", "", 3, "r", "R2", ["mid", "0"], ["{top}"], None),
        ("d", "/outer", 1, "x", "XA", ["a", "b"], ["inner"], {"rv": "{scale}"}),
        ("d", "/inner", 1, "r", "R1", ["a", "b"], ["{RV}"], {"tc": "odd+1", "w": "top"}),
    ]
    defs = [("d", "", "outer", ["a", "b"], {"scale": "2"}), ("d", "", "inner", ["a", "b"], {"rv": "1k", "half": "rv/2"})]
    cards = spark.createDataFrame(
        cards, "deck string, scope string, line int, letter string, name string, nodes array<string>, args array<string>, params map<string,string>"
    )
    defs = spark.createDataFrame(defs, "deck string, scope string, name string, ports array<string>, defaults map<string,string>")
    told = spark.createDataFrame([("d", {"top": "{base}", "base": "7"})], "deck string, params map<string,string>")
    flat = H.expand_hierarchy(cards, defs, globals=told)
    found = {r.name: (r.arg_values, r["values"], r.leftovers) for r in flat.elements.collect()}
    assert found == {"X1.XA.R1": ([3000.0], {"w": 7.0}, ["tc"]), "X2.XA.R1": ([2.0], {"w": 7.0}, ["tc"]), "R2": ([7.0], {}, [])}
    inside = {r.name: (r.params["rv"] if "rv" in r.params else None, r.params["scale"], r.leftovers) for r in flat.instances.collect()}
    assert inside == {"X1": (None, 3000.0, []), "X2": (None, 2.0, []), "X1.XA": (3000.0, 3000.0, ["half"]), "X2.XA": (2.0, 2.0, ["half"])}
    assert flat.errors.count() == 0
    alone = H.expand_hierarchy(cards.where("name = 'R2'"), defs)
    assert alone.instances.count() == 0 and [r.arg_values for r in alone.elements.collect()] == [[None]]
