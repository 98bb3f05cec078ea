"""Ranked search against plain scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwave.llm import ball_search

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def ranked(rows, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    holding = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda r: r[:2] if r[1] else r)
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(docs, items, k=50):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ball_search.rank(docs, items, k=k).collect()), key=str)


ITEMS = [(1, "fox and river"), (2, None), (3, "!!"), (4, "ÜNÏCÖDÉ 漢字 tale7 story"), (5, "Common LINE end line"), (5, "repeat it"), (None, "word3 and7 tale5"), (6, "nowhere-met")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_odd_texts(spark, docs, rows, empty, k):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    assert found(docs, items, k) == ranked(rows, ITEMS, k)
    assert found(empty, items) == [] and found(docs, items.limit(0)) == []


def test_small_blocks_and_trees(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(ball_search, "BLOCK_TERMS", 4)
    assert found(docs, items) == ranked(rows, ITEMS)


def test_ties_and_start(spark):
    """Many equal documents, among them the best ones, on both sides of the k-th place."""
    rows = [(k, "alpha beta" if k % 3 else "alpha gamma delta") for k in range(900)] + [(k, f"alpha beta beta w{k % 5}") for k in range(900, 960)]
    items = [(1, "beta alpha"), (2, "w3 gamma"), (3, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(docs, spark.createDataFrame(items, "item_id long, text string")) == ranked(rows, items)


def test_words_as_ids(spark):
    rows = [(f"d{k:03}", f"alpha {'beta ' * (k % 4)}") for k in range(200)] + [(None, "alpha beta beta beta")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert found(docs, spark.createDataFrame([(1, "beta")], "item_id long, text string")) == ranked(rows, [(1, "beta")])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([1, 2, 8]))
def test_bounds_and_search(seed, leaf):
    rnd = np.random.default_rng(seed)
    dims, rows = int(rnd.integers(3, 30)), int(rnd.integers(1, 60))
    dense = rnd.integers(0, 12 * 10**9, (rows, dims)) * (rnd.random((rows, dims)) < 0.3)
    dense[:, 0] = np.maximum(dense[:, 0], 1)
    if rows > 4:
        dense[2:4] = dense[1]
    row, term = np.nonzero(dense)
    start = np.searchsorted(row, np.arange(rows + 1))
    before, ball_search.LEAF = ball_search.LEAF, leaf
    try:
        tree = ball_search.Tree(start, term, dense[row, term], dims).finish()
    finally:
        ball_search.LEAF = before
    items = [np.unique(rnd.integers(0, dims, 4)) for _ in range(5)]
    best = [ball_search.Best(3, 0) for _ in items]
    for q in items:
        scores, bound = dense[:, q].sum(axis=1), tree.bounds(q)
        for node, docs in enumerate(tree.docs):
            assert bound[node] >= scores[docs].max()
    ball_search.search(tree, list(range(rows)), items, best)
    for q, b in zip(items, best, strict=True):
        b.trim()
        scores = dense[:, q].sum(axis=1).tolist()
        want = sorted((-s, False, i) for i, s in enumerate(scores) if s > 0)[:3]
        assert b.rows == want


def test_query(spark):
    from sparkwave.llm import suite

    folder = "/root/testdata/sf0.001"
    rows, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    result = suite.QUERIES["op12_ball_search"](spark, folder).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in result), key=str) == ranked(rows, items)
