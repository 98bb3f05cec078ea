"""Encoding and decoding against the library, with and without what is remembered."""

import sys
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwave.llm import byte_bpe, packing, suite, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def the_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return the_library()


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]


@pytest.mark.parametrize("remember", [0, 3, byte_bpe.REMEMBER])
def test_documents(docs, rows, empty, library, remember):
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    encoded = byte_bpe.encode(docs, PATH, remember=remember)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in encoded.collect()), key=str) == sorted(want, key=str)
    back = byte_bpe.decode(encoded, PATH)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t) for i, _, t in want), key=str)
    assert byte_bpe.encode(empty, PATH).count() == 0


def test_bytes_that_are_no_text(spark, library):
    ids = [[99], [120, 50256, 3], None, [162, 120, 15], []]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    found = {r.doc_id: r.text for r in byte_bpe.decode(df, PATH).collect()}
    assert found == {k: library.decode(x or [], skip_special_tokens=False) for k, x in enumerate(ids)}


def test_every_code_point(library):
    """Alone, doubled, after a space, beside a letter, a digit and a comma; all three users of the vocabulary agree with the library.

    Code points with no character yet are one class to every engine, so one in 97 of them is enough.
    """
    e, ids, counter = byte_bpe.PrefixEncoder(PATH), packing.TokenIds(PATH), token_counts.Counter(PATH)
    every = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") or c % 97 == 0 and not 0xD800 <= c < 0xE000]
    for begin in range(0, len(every), 20_000):
        texts = [f"{c} {c}{c} a{c}a 1{c}1,{c}," for c in every[begin : begin + 20_000]]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert ids_of(e, texts) == want
        assert [ids.encode(t).tolist() for t in texts] == want
        assert [counter.count(t) for t in texts] == list(map(len, want))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abthe ing\n\t's'll1,é漢😀 \x85", "<|endoftext|>", "ing", "  ", "aaaa"]), max_size=90), min_size=1, max_size=4))
def test_random_texts(parts):
    texts = list(map("".join, parts))
    assert ids_of(byte_bpe.encoder(PATH, 0), texts) == [x.ids for x in the_library().encode_batch(texts, add_special_tokens=False)]


def test_long_and_short_words_agree(monkeypatch):
    e, rnd = byte_bpe.encoder(PATH, 0), np.random.default_rng(5)
    words = ["".join(rnd.choice([*"theins'a"], rnd.integers(1, 60))).encode() for _ in range(400)]
    found = e.words(words)
    monkeypatch.setattr(byte_bpe, "SHORT", 0)
    assert e.words(words) == found
    for w, ids in zip(words, found, strict=True):
        assert b"".join(e.bytes[i] for i in np.frombuffer(ids, "<i4")) == w


def test_stretch_without_border_around_the_bound(library):
    e, ids = byte_bpe.encoder(PATH), packing.TokenIds(PATH)
    for n in (packing.TokenIds.LONG - 1, packing.TokenIds.LONG, packing.TokenIds.LONG + 1):
        for text in ("xy" * (n // 2) + "z" * (n % 2), " " * n):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids_of(e, [text])[0] == want == ids.encode(text).tolist()


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
    found = suite.QUERIES["op11_byte_bpe"](spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want and len(found) == len(want)
