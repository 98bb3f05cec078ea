"""Every operator on odd texts against plain versions: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import brute
import numpy as np
import public_tokenizers
import pytest

from sparkwave.llm import exact_dedup, jaccard_join, line_dedup, linear, packing, piece_bpe, quality_classifier, quality_rules, token_counts, toxicity, url_filter

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def bag(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_exact(docs, rows, empty):
    found = exact_dedup.classes(docs, block_bytes=16).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute.exact(rows)
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({r.text_sha256: 1 for r in found})
    assert exact_dedup.classes(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert bag(kept, "doc_id") == sorted(((r.keep_id,) for r in found if r.kept), key=str)


def test_exact_hot_blocks(spark):
    rows = [(k, "ab" * 40 + str(k % 3)) for k in range(300)] + [(k, "ab" * 40 + f" {k}") for k in range(300, 330)]
    found = exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=16)
    assert bag(found, "doc_id", "keep_id", "group_size", "text_sha256") == brute.exact(rows)


def test_token_counts(docs, rows, empty, library):
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    for size in (1 << 16, 50):
        assert bag(token_counts.count_tokens(docs, BYTES, chunk_chars=size), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_chunk_maps_compose(library):
    c = token_counts.counter(BYTES)
    rnd = np.random.default_rng(3)
    letters = [*"ab  \n\t'st漢<|>", "<|endoftext|>", "\u00a0", "\u3000", "ing", "\x1c", "\x85"]
    for _ in range(300):
        text = "".join(rnd.choice(letters, rnd.integers(0, 40)))
        size = int(rnd.integers(1, 9))
        maps = [c.map_of(text[i : i + size]) for i in range(0, len(text), size)] or [c.map_of("")]
        assert c.total(maps) == c.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_packing(docs, rows, empty, library):
    found = packing.pack(docs, BYTES, sequence_tokens=64).collect()
    by_text: dict = {}
    for r in found:
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.length == 1 << r.bucket and len(r.ids) == 4 * r.length and r.offset == 0
        by_text.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert len({r.sequence_id for r in found}) == len(found)
    assert sorted(found, key=lambda r: r.sequence_id) == sorted(found, key=lambda r: (r.bucket, r.sequence_id))
    for i, t in rows:
        if i is None or i == 7:
            continue
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        parts = sorted(by_text[i, len(ids)], key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert b"".join(r.ids for r in parts) == np.array(ids, "<u4").tobytes()
    assert sum(r.length for r in found if r.doc_id == 7) == 2 * (len(library.encode(dict(rows)[7]).ids) + 1)
    assert packing.pack(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTES, sequence_tokens=100)


def test_other_vocabulary(library):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = packing.TokenIds(path)
    assert t.fast is None and packing.TokenIds(BYTES).fast is not None
    assert t.encode("Some Words here").tolist() == Tokenizer.from_file(path).encode("Some Words here", add_special_tokens=False).ids


def test_pieces(docs, rows, empty):
    p = piece_bpe.Pieces(PIECES)
    want = []
    for i, t in rows:
        ids = p.library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, sha256(np.array(ids, "<u4").tobytes()).hexdigest(), p.library.decode(ids), True))
    found = [(r.doc_id, sha256(r.ids).hexdigest(), r.decoded, r.agrees is not False) for r in piece_bpe.encode(docs, PIECES).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert piece_bpe.encode(empty, PIECES).count() == 0


def test_piece_agendas_agree():
    p = piece_bpe.Pieces(PIECES)
    rnd = np.random.default_rng(4)
    for _ in range(200):
        text = list("".join(rnd.choice([*"▁theins漢é\n"], rnd.integers(1, 40))))
        assert p._short(list(text)) == p._long(text)


def odd_words(n=3000):
    rnd = np.random.default_rng(6)
    letters = [*"theinsandr,.;!?0123456789ABé漢한😀\x00\n\n\u200b", piece_bpe.SPACE_MARK]
    made = ["".join(rnd.choice(letters, rnd.integers(1, 60))) for _ in range(n)]
    return [*dict.fromkeys([*made, "", "x" * 47, "x" * 48, "x" * 49, "漢" * 300, "aaaaaaaaaaaa"])]


def test_new_words_are_merged_side_by_side(monkeypatch):
    p, words = piece_bpe.Pieces(PIECES), [f"word{k}" for k in range(5000)]
    alone = []
    monkeypatch.setattr(piece_bpe.Pieces, "merge", lambda self, w, merge=piece_bpe.Pieces.merge: alone.append(w) or merge(self, w))
    [(ids, text, agree)] = p.encode([" ".join(words)])
    assert not alone and agree and text == " ".join(words)
    assert ids == np.array(p.library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


@pytest.mark.parametrize("together", [64, 4096])
def test_side_by_side_is_the_agenda_of_each_word(together, monkeypatch):
    monkeypatch.setattr(piece_bpe, "TOGETHER", together)
    p, words = piece_bpe.Pieces(PIECES), [piece_bpe.SPACE_MARK + w for w in odd_words()]
    again, ids, ends = p._merge_all(words)
    assert sorted(again) == sorted(words)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [p.merge(w) for w in again]
    assert not p._compile(odd_words()).keys() ^ set(odd_words()) and not p.disputed


def test_pieces_of_texts_with_odd_spaces_and_characters():
    p, rnd = piece_bpe.Pieces(PIECES), np.random.default_rng(7)
    words = [*odd_words(400), *[""] * 200]
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 9))) for _ in range(600)] + ["", " ", "  ", "▁", " a", "a ", "a  b", "a▁b"]
    for begin in range(0, len(texts), 100):
        part = texts[begin : begin + 100]
        theirs = [p.library.encode(t, add_bos=True, add_eos=True) for t in part]
        assert p.encode(part) == [(np.array(ids, "<u4").tobytes(), p.library.decode(ids), True) for ids in theirs]


def test_disputed_words_take_the_ids_of_the_library():
    p = piece_bpe.Pieces(PIECES)
    words = [f"word{k}é" for k in range(100)]
    p.pairs.rank[:] = piece_bpe.NEVER  # nothing merges
    made = p._compile([*words, "漢😀"])
    assert p.disputed == set(words)
    assert all(made[w] == (np.array(p.library.encode(w), "<u4").tobytes(), " " + w) for w in [*words, "漢😀"])
    assert [agree for *_, agree in p.encode([f"b {words[0]}", "漢😀"])] == [False, True]


def test_lines(docs, rows, empty):
    assert bag(line_dedup.drop_common_lines(docs), "doc_id", "n_lines", "n_dropped", "kept") == brute.lines(rows, 10)
    assert bag(line_dedup.drop_common_lines(docs, min_documents=2), "doc_id", "n_lines", "n_dropped", "kept") == brute.lines(rows, 2)
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_lines_through_the_arrays(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LINES", 1)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 8)
    assert bag(line_dedup.drop_common_lines(docs, min_documents=3), "doc_id", "n_lines", "n_dropped", "kept") == brute.lines(rows, 3)


def test_perfect_hash():
    from sparkwave.llm.perfect_hash import PerfectHash

    rnd = np.random.default_rng(1)
    hi, lo = rnd.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    counts = rnd.integers(1, 10, 5000).astype(np.uint8)
    made = PerfectHash.from_bytes(PerfectHash.build(hi, lo, counts).to_bytes())
    assert sorted(made.index(hi, lo)) == list(range(5000))
    assert (made.lookup(hi, lo) == counts).all()
    assert (made.lookup(lo, hi) == 0).mean() > 0.99


def test_quality_rules(docs, rows, empty):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality_rules.judge(docs)
    found = sorted(((r.doc_id, *(r.quality[f] for f in fields)) for r in judged.collect()), key=str)
    assert found == sorted(((i, *brute.quality(t)) for i, t in rows), key=str)
    assert quality_rules.judge(docs, out="score").columns == docs.columns[:6] + ["score"] + docs.columns[7:]
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and bag(kept, "doc_id") == sorted(((r.doc_id,) for r in judged.collect() if r.quality.kept), key=str)


@pytest.mark.parametrize("light", [0, 4, 14, None])
def test_near_copies(docs, rows, empty, light):
    assert bag(jaccard_join.join(docs, light=light), "doc_id", "n_shingles", "component_id") == sorted(brute.near_components(rows), key=str)
    if light is None:
        assert jaccard_join.join(empty).count() == 0
        kept = jaccard_join.drop_near_copies(docs)
        assert kept.columns == docs.columns
        found = sorted({c for _, _, c in brute.near_components(rows) if c is not None})
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == found


def test_near_copies_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 8)
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(160):
        words = [f"w{k}" for k in range(40 if i % 4 else 9)]
        for k in rnd.integers(0, len(words), rnd.integers(0, 3)):
            words[k] = f"x{rnd.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(jaccard_join.join(df), "doc_id", "n_shingles", "component_id") == sorted(brute.near_components(rows), key=str)


def test_one_id_on_unlinked_texts(spark):
    """Each of them is the least of a group of its own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in ("tale", "song", "poem"))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (1, c), (1, c), (4, c), (5, ""), (5, "one two"), (5, "one two")]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(kept, "doc_id", "text") == sorted([(1, a), (1, b), (1, c), (5, ""), (5, "one two")], key=str)


def test_toxicity(spark, docs, empty):
    bad = ["idiot", "moron", "scum"]
    rows = [(k, f"some plain words number{k} here" + "".join(f" {b}!" for b in bad[: k % 4])) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(800) if k % 5] + [(None, 1), (5, None), (2, 1)], "doc_id long, toxic int")
    graded = toxicity.grade(df, toxicity.fit(df, labels)).select("doc_id", "toxicity.*").collect()
    assert all(r.rejected == (r.doc_id % 4 > 0) for r in graded)
    mean = [np.mean([r.severity for r in graded if r.doc_id % 4 == g]) for g in range(4)]
    assert mean == sorted(mean)
    model = toxicity.fit(df, labels)
    assert all(t <= u for t, u in zip(model.thresholds, model.thresholds[1:]))
    assert toxicity.grade(docs, model).columns == [*docs.columns, "toxicity"]
    assert toxicity.grade(empty, model).count() == 0
    nothing = toxicity.fit(empty, labels)
    assert {(r.severity, r.rejected) for r in toxicity.grade(docs, nothing).select("toxicity.*").collect()} == {(0.0, False)}


def test_labels_of_other_ids_take_no_place(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(30)] + [(3, "again"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)] + [(None, 1)], "doc_id long, toxic int")
    found = linear.labelled_sample(df, labels, "doc_id", "text", "toxic", 20).collect()
    assert len(found) == len({r.id for r in found}) == 20 and all(r.id < 30 and r.label == r.id % 2 for r in found)
    assert {r.id for r in linear.labelled_sample(df, labels, "doc_id", "text", "toxic", 100).collect()} == set(range(30))


def test_toxicity_learns_features_of_enough_rows(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "learn", lambda words, rows, y, grades: given.append((words, rows, y)))
    texts = {k: f"plain number{'abcdefghij'[k % 10] * 3} only{'xyz'[k % 3] * (k // 3 + 1)} {'scum' if k % 2 else ''}" for k in range(24)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    toxicity.fit(df, spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, toxic int"))
    words, rows, y = given[0]
    times = Counter(int(w) for t in texts.values() for w in toxicity.features(t))
    assert words.tolist() == sorted(w for w, n in times.items() if n >= toxicity.MIN_ROWS) and len(words) < len(times)
    kept = sorted((int(k % 2), [int(w) for w in toxicity.features(t) if times[int(w)] >= toxicity.MIN_ROWS]) for k, t in texts.items())
    assert sorted((int(g), words[at].tolist()) for g, at in zip(y, rows, strict=True)) == kept


def test_quality_classifier(spark, docs, rows, empty):
    tables = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    mine = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    model = quality_classifier.fit(df, mine, most=2000)
    held = quality_classifier.score(df.join(labels.join(mine, "doc_id", "left_anti"), "doc_id"), model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) > 0.98
    scored = quality_classifier.score(docs, model).collect()
    assert Counter(r.doc_id for r in scored) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.fit(empty, mine).score("any text") == 0.5


def test_urls(spark):
    urls = [
        None, "", "no scheme", "https://", "http://ORG", "http://ORG/", "http://a.Example.org/es/x?y=1#z", "http://example.org/en/1", "http://example.org/en/2",
        "x://notorg/", "http://my.com/fr/", "http://my.com/de/1", "http://my.com/en/", "http://com?/fr/", "http://host#a/b?c", "a://b://c/d", "http://Ä.com/fr/é",
        "http://x.net/" + "a1/" * 5000,
    ]
    urls += [f"http://s{k}.example.org/en/{k}" for k in range(40)] + [f"http://s{k}.com/{'de' if k % 2 else 'fr'}/{k}" for k in range(40)]
    df = spark.createDataFrame([(k, u, "h", k) for k, u in enumerate(urls)], "page_id long, url string, host string, f_rule int")
    model = url_filter.fit(df)
    found = url_filter.judge(df, model)
    assert found.columns == [*df.columns, "filter"]
    verdict = {r.text: r.verdict for r in url_filter.RULES}
    for r in found.collect():
        assert (r["filter"].host, r["filter"].path, r["filter"].rule) == brute.host_path_rule(r.url, url_filter.RULES), r.url
        assert r["filter"].verdict in ("allow", "block") and r["filter"].verdict == verdict.get(r["filter"].rule, r["filter"].verdict)
    assert url_filter.judge(df.limit(0), url_filter.fit(df.limit(0))).count() == 0
    only = df.where("url like '%/fr/%'")
    assert {r["filter"].verdict for r in url_filter.judge(df, url_filter.fit(only)).collect() if r["filter"].rule is None} == {"allow"}


@pytest.mark.parametrize("copied", [True, False])
def test_url_suffixes_cover_all_rows(spark, monkeypatch, copied):
    """More suffixes than fit any cap, most of them never named by a rule, and a fit on far fewer rows."""
    if not copied:
        monkeypatch.setattr(url_filter, "broadcast_if_small", lambda df: df)
    urls = [f"http://a{k}.com/{'de' if k % 3 else 'fr'}/{k}" for k in range(60)] + [f"http://b.org/{k % 4}" for k in range(40)]
    urls += [f"http://c{k}.net/en/{k}" for k in range(300)] + [f"http://d.s{k}/" for k in range(1200)] + [None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    model = url_filter.fit(df, most=50)
    share, n = 40 / 100, len(urls)
    known = {"com": ((40 + 20 * share) / (60 + 20), 60 / n), "org": (20 * share / (40 + 20), 40 / n), "net": (share, 300 / n), "": (share, 1 / n)}
    known |= {f"s{k}": (share, 1 / n) for k in range(1200)}
    found = {r.suffix: (r.f_suffix_share, r.f_suffix_count) for r in model.suffix.collect()}
    assert found.keys() == known.keys() and all(found[s] == pytest.approx(known[s]) for s in known)
    asked = spark.createDataFrame([("http://x.net/",), ("http://x.never/",)], "u string")
    host, path = url_filter.host_and_path(asked["u"])
    rows = model.features(asked, asked["u"], host, path).collect()
    assert sorted((r.f_suffix_share, r.f_suffix_count) for r in rows) == [pytest.approx((share, 0.0)), pytest.approx(known["net"])]
    judged = url_filter.judge(df, model).collect()
    assert sorted(r.page_id for r in judged) == list(range(n))


def test_entropy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcdabcd",)], "s string")
    assert [round(r.e, 6) for r in df.select(url_filter.entropy(F.col("s")).alias("e")).collect()] == [0.0, 0.0, 1.0, 2.0]


def test_digests(spark, docs):
    from pyspark.sql import functions as F

    r = packing.pack(docs, BYTES).withColumn("c", F.crc32("ids")).first()
    assert r.c == crc32(r.ids)
