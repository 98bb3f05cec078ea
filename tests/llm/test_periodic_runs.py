"""Runs against a version that compares all words with all shifts."""

import random
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from sparkwave.llm import periodic_runs


def stretches(w, least):
    """``(start, end, smallest period)`` of the longest stretches with a period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= least(q):
                best.setdefault((start, i + q), q)
    return sorted((s, e, q) for (s, e), q in best.items())


def runs(w):
    return [(s, q, e - s) for s, e, q in stretches(w, lambda q: max(24, 3 * q))]


def collapsed(w):
    gone = {i for s, q, n in runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_of_blocks(rnd, most):
    words = []
    for _ in range(rnd.randint(1, 5)):
        block = [str(rnd.randint(0, rnd.choice([1, 3, 1000]))) for _ in range(rnd.choice([1, 2, 3, 7, 12, 15, 16, 17, 31, 64, 65, 130, 200]))]
        words += block * rnd.choice([1, 1, 2, 3, 4, 8]) + block[: rnd.randint(0, len(block))]
    return words[:most]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_tiles(seed):
    rnd = random.Random(seed)
    tiles = [np.array([hash(x) for x in made_of_blocks(rnd, 600)], np.int64) for _ in range(3)]
    for low, high in ((1, 128), (128, 256), (256, 512)):
        found = sorted(periodic_runs.fragments(tiles, low, high))
        want = [(k, q, s, e) for k, w in enumerate(tiles) for s, e, q in stretches(w.tolist(), lambda q: max(24, 2 * q)) if low <= q < high]
        assert found == sorted(want)


def test_z_function():
    for x in ([], [1], [1, 1, 1, 2], [1, 2, 1, 2, 1, 3, 1, 2]):
        z = periodic_runs.z_function(x)
        assert z == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def check(df, rows):
    want = sorted(((i, runs(brute.words(t)), collapsed(brute.words(t))) for i, t in rows), key=str)
    found = periodic_runs.with_runs(df).collect()
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str) == want


def test_odd_texts(docs, rows, empty):
    usual = [r for r in rows if r[0] not in (9, 10, 18)]
    check(docs.where("doc_id IS NULL OR doc_id NOT IN (9, 10, 18)"), usual)
    assert {r.doc_id: len(r.runs) for r in periodic_runs.with_runs(docs).collect()}[9] == 0
    assert periodic_runs.with_runs(empty).count() == 0 and periodic_runs.find_runs(empty).count() == 0


def test_runs_over_many_tiles(spark, monkeypatch):
    """Small tiles, so that every long run is put together from many."""
    rnd = random.Random(7)
    rows = [(k, " ".join(made_of_blocks(rnd, 3000))) for k in range(60)]
    rows += [(100, "a " * 2500), (101, " ".join(str(k % 601) for k in range(2400))), (102, "x y " * 700 + "z " + "y x " * 500), (102, "x y " * 700), *rows[:5]]
    monkeypatch.setattr(periodic_runs, "BASE", 16)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_full_bit_table(spark, monkeypatch):
    """A table of one row lets nearly every text through to the join, which changes nothing."""
    monkeypatch.setattr(periodic_runs, "SLOTS", 1)
    rows = [(k, " ".join(f"w{j % (7 if k % 3 else 400)}" for j in range(90))) for k in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_digest_of_the_query(spark):
    from sparkwave.llm import suite

    folder = "/root/testdata/sf0.001"
    tails = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", suite.repeated_tail().alias("w"), F.crc32(F.col("doc_id").cast("string")).alias("h"), "text")
    want = {}
    for r in tails.collect():
        w = brute.words(r.text)
        if r.h % 10 == 0 and w:
            g = r.h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        assert r.w == w
        found = runs(w)
        listed = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        want[r.doc_id] = (len(found), sha256(listed.encode()).hexdigest(), sha256(collapsed(w).encode()).hexdigest())
    found = suite.QUERIES["op13_periodic_runs"](spark, folder).collect()
    assert {r.doc_id: (r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in found} == want and len(found) == len(want)
