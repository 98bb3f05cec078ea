"""Registered text queries against SQL or plain versions on the smallest tables."""

import brute
import numpy as np
import pytest
from oracle import compare

import corpus_pipeline
from sparkwave.llm import quality_rules, suite

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(suite.SQL))
def test_sql(spark, name):
    assert compare(spark, FOLDER, name, suite.QUERIES[name], suite.SQL[name]) == ""


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_near_copies(spark, rows):
    found = suite.QUERIES["op10_jaccard_join"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute.near_components(rows))


def test_token_counts_and_pieces(spark, rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    found = suite.QUERIES["op2_token_counts"](spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in found} == want and all(r.over_limit == (r.n_tokens > 1024) for r in found)
    assert {r.doc_id: r.doc_tokens for r in suite.QUERIES["op7_packing"](spark, FOLDER).collect()} == {i: n + 1 for i, n in want.items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = suite.QUERIES["op4_piece_bpe"](spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(sp.encode(t)) + 2 for i, t in rows} and {r.agrees for r in found} == {True, None}


@pytest.mark.parametrize("name", ["op3_toxicity", "op5_quality_classifier"])
def test_one_row_per_document(spark, rows, name):
    assert sorted(r.doc_id for r in suite.QUERIES[name](spark, FOLDER).collect()) == sorted(i for i, _ in rows)


def test_urls(spark):
    from sparkwave.llm.url_filter import RULES

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()}
    found = suite.QUERIES["op9_url_filter"](spark, FOLDER).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in found} == {p: brute.host_path_rule(u, RULES) for p, u in pages.items()}


def test_pipeline(spark, rows):
    """The stages one by one: what each keeps follows from the plain versions on what it was given."""
    docs, given = spark.read.parquet(f"{FOLDER}/documents.parquet"), dict(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        docs = corpus_pipeline.cut(out)
        kept = {r.doc_id for r in docs.collect()}
        if name == "quality rules":
            judged = quality_rules.judge(spark.createDataFrame(list(given.items()), "doc_id long, text string"))
            assert kept == {r.doc_id for r in judged.collect() if r.quality.kept} <= {i for i, t in given.items() if not brute.quality(t)[5]}
        elif name == "exact dedup":
            assert kept == {keep for _, keep, _, _ in brute.exact(list(given.items()))}
        elif name == "n-gram Jaccard join":
            assert kept == {c for _, _, c in brute.near_components(list(given.items()))}
        else:
            assert kept <= set(given)
        given = {i: t for i, t in given.items() if i in kept}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == set(given)
    for i in given:
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == own[0].doc_tokens == np.sum([len(r.ids) // 4 for r in own])
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()} == set(given)
