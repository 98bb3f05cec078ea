"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its components.

Documents become sets of word shingles; equal sets are one class (a hot group of
copies is one class), and classes with similarity of at least ``percent`` link.

* Order. Shingles are counted over all documents (a shingle is told by its bits: block
  and place) and ordered by the binary logarithm of the count, then by place. Two
  similar sets share an element among the first ``n - ceil(percent n) + 1`` of each
  (prefix filter), and an element met once is shared with nobody.
* Heavy sets put these first, shared elements on inverted lists. Lists with the same
  members are one list.
* Light sets list all their subsets of ``ceil(percent m)`` elements for every size m
  that a light partner can have: two similar light sets share one. The boundary between
  light and heavy is the size with the least total cost, from the sizes of all classes
  and the mean list length.
* Scanning. Every list compares its members with its first one, then those not yet
  linked with the member closest to it. Both steps are linear in the lists, and what
  they find becomes components. Only members of different components of one list are
  compared after that: short lists by pairs, long lists block against block inside
  tasks, from which a spanning set of links comes back. So no list becomes all pairs,
  and no two linked texts are missed.

Counting moves three bytes per shingle in packed arrays; texts move only for classes
that are on a list. All intermediate results are written tables.

Defined results: null and empty texts, and texts without words, have the empty set and
link with nothing. A text of fewer words than a shingle is one shingle. Repeated rows
are documents of one class. ``component_id`` is the smallest id; null ids count as
unknown and never are one. Elements are 64-bit hashes, classes 128-bit hashes of sets.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.shingles import WORDS, shingle_set
from sparkwave.operators.graph import components
from sparkwave.plans.lineage import cut, discard

PERCENT = 80
CHUNK_SHINGLES = 1 << 19
BLOCK_SHINGLES = 1 << 20
PLACE_BITS = 24
#: Sizes up to which a set may be light.
MOST_LIGHT = 20
#: Lists above this length are compared block against block.
LONG_LIST = 64
BLOCK_MEMBERS = 512
#: Ids of at most so many classes are copied to the tasks to pick their texts; more are joined.
COPIED_IDS = 1_000_000
#: Costs relative to one listed subset: an element sent for counting, a comparison.
_COST_ELEMENT, _COST_COMPARISON = 3.0, 4.0


def least_shared(n: int, percent: int) -> int:
    """Elements that a set of ``n`` shares with any similar set, at least."""
    return -(-percent * n // 100)


def subset_sizes(n: int, most: int, percent: int) -> list[int]:
    """Subset sizes that a set of ``n`` must list to meet all light partners of up to ``most`` elements."""
    return sorted({least_shared(m, percent) for m in range(n, min(100 * n // percent, most) + 1)})


def _binomial(n: int, k: int) -> int:
    out = 1
    for i in range(min(k, n - k)):
        out = out * (n - i) // (i + 1)
    return out


def boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The largest light size. ``sizes``: classes of every size up to ``MOST_LIGHT``."""

    def cost(most: int) -> float:
        total = 0.0
        for n, times in sizes.items():
            if n <= most:
                total += times * sum(_binomial(n, k) for k in subset_sizes(n, most, percent))
            if 100 * n > percent * most:
                total += times * (_COST_ELEMENT * n + _COST_COMPARISON * list_length * (n - least_shared(n, percent) + 1))
        return total

    return min(range(MOST_LIGHT + 1), key=lambda most: (cost(most), most))


def _name(found: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(blake2b(found.tobytes(), digest_size=16).digest(), "<i8")
    return int(digest[0]), int(digest[1])


def _planes(places: np.ndarray) -> bytes:
    return b"".join((places >> (8 * k)).astype(np.uint8).tobytes() for k in range(3))


def _places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


_CHUNKS = "chunk long, block int, places binary, owners binary, ids array<{}>, d1 array<long>, d2 array<long>, sizes array<int>, c1 array<long>, c2 array<long>, small array<binary>"


def _chunks(docs: DataFrame, block_bits: int, shingle_words: int) -> DataFrame:
    """Per chunk of documents: one row with their names and sizes (block -1), and a row per block with the places of their shingles."""
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    longs, ints, blobs = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())

    def rows(chunk: int, held: list, id_type: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(id_type), longs, longs, ints, longs, longs, blobs]
        sets = [h[2] for h in held]
        classes = [_name(s) for s in sets]
        small = [s.astype("<u8").tobytes() if len(s) <= MOST_LIGHT else None for s in sets]
        first = [chunk, -1, None, None, [h[3] for h in held], [h[0] for h in held], [h[1] for h in held], [len(s) for s in sets], [c[0] for c in classes], [c[1] for c in classes], small]
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        key = (np.concatenate(sets) >> np.uint64(64 - PLACE_BITS - block_bits)).astype(np.int64)
        block = (key >> PLACE_BITS).astype(np.int32)
        order = np.argsort(block, kind="stable").astype(np.int32)
        ends = np.searchsorted(block[order], np.arange((1 << block_bits) + 1))
        out = [first]
        for b in range(1 << block_bits):
            part = order[ends[b] : ends[b + 1]]
            if len(part):
                counts = np.bincount(owner[part], minlength=len(sets)).astype("<u4")
                out.append([chunk, b, _planes(key[part] & ((1 << PLACE_BITS) - 1)), counts.tobytes(), *[None] * 7])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, load = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            id_type = batch["id"].type
            for d1, d2, t, i in zip(*(batch[x] for x in ("d1", "d2", "t", "id")), strict=True):
                found = shingle_set(t.as_py(), shingle_words)
                held.append((d1.as_py(), d2.as_py(), found, i.as_py()))
                load += len(found) + 8
                if load >= CHUNK_SHINGLES:
                    yield rows(chunk, held, id_type)
                    chunk, held, load = chunk + 1, [], 0
        if held:
            yield rows(chunk, held, id_type)

    return map_batches(docs.select("id", "d1", "d2", "t"), run, _CHUNKS.format(docs.schema["id"].dataType.simpleString()))


def _levels(chunks: DataFrame) -> DataFrame:
    """For every chunk and block the places that more than one shingle has, with the logarithm of their number."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = [], []
            for data in batch["places"]:
                at, times = np.unique(_places(data.as_py()), return_counts=True)
                places.append(_planes(at))
                counts.append(np.minimum(times, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["block"], pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "block", "places", "counts"])

    def count(group: pa.Table) -> pa.Table:
        parts = [_places(x.as_py()) for x in group["places"]]
        times = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in group["counts"]]).astype(np.int64)
        at, back = np.unique(np.concatenate(parts), return_inverse=True)
        level = np.log2(np.bincount(back, times)).astype(np.uint8)[back]
        places, levels, start = [], [], 0
        for part in parts:
            own = level[start : start + len(part)]
            start += len(part)
            places.append(_planes(part[own > 0]))
            levels.append(own[own > 0].tobytes())
        return pa.table({"chunk": group["chunk"], "block": group["block"], "places": pa.array(places, pa.binary()), "levels": pa.array(levels, pa.binary())})

    sent = map_batches(chunks.where("block >= 0").select("chunk", "block", "places"), distinct, "chunk long, block int, places binary, counts binary")
    return sent.groupBy("block").applyInArrow(count, "chunk long, block int, places binary, levels binary")


def _lists(chunks: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """``(c, n, key)``: the shared elements among the first of every set; ``c`` is the first half of the class name."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left["block"].to_numpy()
        heads = np.flatnonzero(block < 0)
        known = {b: k for k, b in enumerate(right["block"].to_pylist())}
        owners, keys, ranks = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(heads):
            sizes = np.array(left["sizes"][heads[0]].as_py(), np.int64)
            classes = np.array(left["c1"][heads[0]].as_py(), np.int64)
        else:
            sizes, classes = np.empty(0, np.int64), np.empty(0, np.int64)
        for row in np.flatnonzero(block >= 0):
            if (k := known.get(int(block[row]))) is None:
                continue
            shared, level = _places(right["places"][k].as_py()), np.frombuffer(right["levels"][k].as_py(), np.uint8)
            if not len(shared):
                continue
            places = _places(left["places"][int(row)].as_py())
            owner = np.repeat(np.arange(len(sizes)), np.frombuffer(left["owners"][int(row)].as_py(), "<u4"))
            at = np.minimum(np.searchsorted(shared, places), len(shared) - 1)
            hit = shared[at] == places
            owners.append(owner[hit])
            keys.append((int(block[row]) << PLACE_BITS) | places[hit])
            ranks.append(level[at[hit]].astype(np.int64))
        owner, key, rank = np.concatenate(owners), np.concatenate(keys), np.concatenate(ranks)
        order = np.lexsort((key, rank, owner))
        owner, key = owner[order], key[order]
        number = np.bincount(owner, minlength=len(sizes))
        begin = np.cumsum(number) - number
        # elements met once come first and are on no list
        prefix = sizes + percent * -sizes // 100 + 1
        take = np.where(sizes > 0, prefix - (sizes - number), 0)
        kept = np.arange(len(owner)) - begin[owner] < take[owner]
        owner, key = owner[kept], key[kept]
        return pa.table({"c": pa.array(classes[owner], pa.int64()), "n": pa.array(sizes[owner], pa.int32()), "key": pa.array(key, pa.int64())})

    both = chunks.select("chunk", "block", "places", "owners", "sizes", "c1").groupBy("chunk").cogroup(levels.groupBy("chunk"))
    return both.applyInArrow(run, "c long, n int, key long")


def _subsets(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """``(c, n, key)`` of all subsets that light sets list; these keys are negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n, small in zip(batch["c"].to_pylist(), batch["n"].to_pylist(), batch["small"].to_pylist(), strict=True):
                items = [small[8 * k : 8 * k + 8] for k in range(n)]
                keys = [
                    int.from_bytes(blake2b(b"".join(chosen), digest_size=8).digest(), "little") | 1 << 63
                    for k in subset_sizes(n, most, percent)
                    for chosen in combinations(items, k)
                ]
                key = np.array(keys, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int32()), pa.array(key)], ["c", "n", "key"])

    light = classes.where((F.col("n") > 0) & (F.col("n") <= most)).select("c", "n", "small")
    return map_batches(light, run, "c long, n int, key long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the number of ``shared`` elements and the sizes ``na`` and ``nb``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, na, nb = [], [], []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared.append(len(np.intersect1d(p, q, assume_unique=True)))
                na.append(len(p))
                nb.append(len(q))
            made = [pa.array(v, pa.int32()) for v in (shared, na, nb)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *made], ["a", "b", "shared", "na", "nb"])

    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("items").alias("y")), "b")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long, shared int, na int, nb int")


def _linked(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    found = members.join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    return found.withColumn("root", F.coalesce("root", "c"))


def _mixed(members: DataFrame) -> DataFrame:
    """The lists that have members of several components."""
    spread = members.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return members.join(spread.select("list"), "list")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of lists that the links leave in several components, with their roots.

    Each step is written, so that no plan holds the exchanges of several steps.
    """
    roots = cut(components(links))
    placed = cut(_with_roots(members, roots))
    discard(roots)
    spread = cut(_mixed(placed))
    discard(placed)
    return spread


def _short_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components, sizes permitting, from lists of at most ``LONG_LIST`` members."""
    own = members.where(F.col("length") <= LONG_LIST).select("list", "c", "n", "root")
    other = own.select("list", *[F.col(x).alias(x + "2") for x in ("c", "n", "root")])
    fit = (F.col("c") < F.col("c2")) & (F.col("root") != F.col("root2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    return own.join(other, (own["list"] == other["list"]) & fit).select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct()


def _from_lead(members: DataFrame) -> DataFrame:
    """Members of lists above ``LONG_LIST``, and whether they are in the component of the list's first one."""
    long = members.where(F.col("length") > LONG_LIST)
    heads = long.where(F.col("c") == F.col("first")).select("list", F.col("root").alias("first_root"))
    return long.join(heads, "list").withColumn("lead", F.col("root") == F.col("first_root"))


def _long_links(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components of long lists; not all of them, but enough to join what belongs together.

    Members in the component of the first one are dealt into blocks of one kind, the
    others into blocks of another; only pairs of blocks with one of the others meet.
    """

    def run(group: pa.Table) -> pa.Table:
        c, root = group["c"].to_numpy(), group["root"].to_numpy()
        items = [np.frombuffer(x.as_buffer(), "<u8") for x in group["items"]]
        size = np.array([len(x) for x in items])
        every, owner = np.concatenate(items), np.repeat(np.arange(len(items)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        starts = np.flatnonzero(np.diff(every, prepend=~every[:1]))
        times = np.diff([*starts, len(every)])
        common = np.repeat(times > 1, times)
        column = np.repeat(np.cumsum(times > 1) - 1, times)[common]
        who = owner[common]
        shared = np.zeros((len(items), len(items)), np.float32)
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, (begin, begin + 4096)))
            has = np.zeros((len(items), 4096), np.float32)
            has[who[part], column[part] - begin] = 1.0
            shared += has @ has.T
        linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        linked &= root[:, None] != root[None, :]
        parent = {int(r): int(r) for r in np.unique(root)}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            p, q = find(int(root[i])), find(int(root[j]))
            if p != q:
                parent[p] = q
                a.append(int(c[i]))
                b.append(int(c[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    numbers = long.groupBy("list").agg(F.count_if("lead").alias("leads"), F.count_if(~F.col("lead")).alias("others"))
    blocks = [F.ceil(F.col(x) / BLOCK_MEMBERS).cast("int").alias("n_" + x) for x in ("leads", "others")]
    long = long.join(numbers.select("list", *blocks), "list")
    own = F.pmod(F.xxhash64("c"), F.when(F.col("lead"), F.col("n_leads")).otherwise(F.col("n_others"))).cast("int")
    long = long.withColumn("own", own)
    # a pair of blocks is named (kind of the first, its number, number of the second, which is one of the others)
    others = F.sequence(F.lit(0), F.col("n_others") - 1)
    leads = F.when(F.col("n_leads") > 0, F.sequence(F.lit(0), F.col("n_leads") - 1)).otherwise(F.array().cast("array<int>"))

    def meeting(kind: int, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    as_lead = F.transform(others, lambda j: meeting(1, F.col("own"), j))
    as_other = F.concat(
        F.transform(leads, lambda i: meeting(1, i, F.col("own"))),
        F.transform(others, lambda j: meeting(0, F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
    )
    met = long.select("list", "c", "root", F.explode(F.when(F.col("lead"), as_lead).otherwise(as_other)).alias("pair"))
    return met.join(sets.select("c", "items"), "c").groupBy("list", "pair").applyInArrow(run, "a long, b long")


def _pick_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``(c, items)``: the sorted elements of the wanted classes, made from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingle_set(t.as_py(), shingle_words).astype("<u8").tobytes() for t in batch["t"]]
            yield pa.RecordBatch.from_arrays([batch["c"], pa.array(items, pa.binary())], ["c", "items"])

    one = cut(classes.join(wanted, "c").groupBy("c").agg(F.min("doc").alias("doc")).select("c", "doc.*"))
    if one.count() <= COPIED_IDS:
        one = F.broadcast(one)
    return map_batches(docs.join(one, ["d1", "d2"]).select("c", "t"), run, "c long, items binary").dropDuplicates(["c"])


def _join(
    df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle_words: int = WORDS, light: int | None = None
) -> DataFrame:
    """One row per row of ``df``: ``d1`` and ``d2`` (the document's name), ``id``, ``n``, ``component_id``, and ``g1``, ``g2`` and ``g3``.

    The last three name the component itself: two components have the same ``component_id`` where one id stands at several texts.
    """
    t = text_of(text)
    docs = df.select(F.col(id).alias("id"), t.alias("t")).select("*", F.xxhash64("id", "t").alias("d1"), F.xxhash64(F.lit(1), "id", "t").alias("d2"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    # about seven bytes a word
    block_bits = max(4, int(total // 7 // BLOCK_SHINGLES).bit_length())
    chunks = cut(_chunks(docs, block_bits, shingle_words))
    heads = chunks.where("block < 0").select(F.explode(F.arrays_zip("ids", "d1", "d2", "sizes", "c1", "c2", "small")).alias("x")).select("x.*")
    named = heads.select(F.col("ids").alias("id"), "d1", "d2", F.col("sizes").alias("n"), F.col("c1").alias("c"), "c2", "small")
    classes = cut(named.groupBy("c", "c2", "n").agg(F.first("small").alias("small"), F.min(F.struct("d1", "d2")).alias("doc"), F.min("id").alias("least"), F.count(F.lit(1)).alias("times")))
    levels = cut(_levels(chunks))
    lists = cut(_lists(chunks, levels, percent).distinct())
    discard(levels)
    if light is None:
        sizes = {r["n"]: r["count"] for r in classes.where((F.col("n") > 0) & (F.col("n") <= MOST_LIGHT)).groupBy("n").count().collect()}
        length = lists.groupBy("key").count().agg(F.coalesce(F.avg("count"), F.lit(0.0))).first()[0]
        light = boundary(sizes, length, percent)
    postings = lists.where(100 * F.col("n") > percent * light).unionByName(_subsets(classes, light, percent))
    postings = cut(postings)
    discard(lists)
    # lists with the same members are one
    signed = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("length"), F.min("c").alias("first"), F.bit_xor(F.xxhash64("c")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("s2")
    )
    kept = cut(signed.where("length > 1").groupBy("length", "first", "s1", "s2").agg(F.min("key").alias("key")).select("key", "length", "first"))
    members = cut(postings.join(kept, "key").withColumnRenamed("key", "list"))
    sets = cut(_pick_texts(docs, classes, members.select("c").distinct(), shingle_words))

    # every member against the first of its list
    star = members.where("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b")).distinct()
    star = cut(_similar(star, sets))
    links = _edges(star.where(_linked(percent)))
    rooted = _apart(members, links)
    # then those left against the member closest to the first
    near = star.select(F.col("a").alias("first"), F.col("b").alias("c"), (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("near"))
    ranked = rooted.join(near, ["first", "c"])
    second = ranked.groupBy("list").agg(F.max_by(F.struct("c", "root"), F.struct("near", "c")).alias("best"))
    again = rooted.join(second, "list").where(F.col("root") != F.col("best.root"))
    again = again.select(F.least("c", "best.c").alias("a"), F.greatest("c", "best.c").alias("b")).distinct()
    if not rooted.isEmpty():
        links = cut(links.unionByName(_edges(_similar(cut(again), sets).where(_linked(percent)))))
        discard(rooted)
        rooted = _apart(members, links)
    # then all that are in different components
    if not rooted.isEmpty():
        short = cut(_edges(_similar(cut(_short_pairs(rooted, percent)), sets).where(_linked(percent))))
        long = cut(_edges(_long_links(cut(_from_lead(rooted)), sets, percent)))
        links = cut(links.unionByName(short).unionByName(long))
    for done in (members, sets, postings, kept, rooted):
        discard(done)
    roots = cut(components(links))

    # the smallest id of a component, for classes of several documents or links
    grouped = classes.where("n > 0").select("c", "c2", "n", "least", "times").join(roots.withColumnRenamed("node", "c"), "c", "left")
    grouped = grouped.where("times > 1 or root is not null")
    whole = grouped.where("root is not null").groupBy("root").agg(F.min("least").alias("whole"))
    known = grouped.join(whole, "root", "left").select("c", "c2", "n", F.coalesce("whole", "least").alias("component_id"), "root")
    out = named.drop("small").join(cut(known), ["c", "c2", "n"], "left")
    # linked classes go by their root, others by the class, and texts without shingles by the document
    linked, classed = F.col("root").isNotNull(), F.col("n") > 0
    group = [
        F.when(linked, F.col("root")).when(classed, F.col("c")).otherwise(F.col("d1")).alias("g1"),
        F.when(linked, F.lit(0)).when(classed, F.col("c2")).otherwise(F.col("d2")).alias("g2"),
        F.when(linked, F.lit(-1)).otherwise(F.col("n")).cast("long").alias("g3"),
    ]
    return out.select("d1", "d2", "id", "n", F.coalesce("component_id", "id").alias("component_id"), *group)


def join(
    df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle_words: int = WORDS, light: int | None = None
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles`` and ``component_id``.

    ``light`` overrides the boundary between light and heavy sets (for tests).
    """
    out = _join(df, id, text, percent, shingle_words, light)
    return out.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), "component_id")


def drop_near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle_words: int = WORDS) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of each component the document with the smallest id.

    Documents without an id stay where their whole component has none. Rows that agree in id and text are one document.
    """
    found = cut(_join(df, id, text, percent, shingle_words))
    stay = found.where(F.col("id") == F.col("component_id")).dropDuplicates(["g1", "g2", "g3"])
    stay = cut(stay.unionByName(found.where(F.col("component_id").isNull())).select("d1", "d2").distinct())
    discard(found)
    # a row is one value here, so that its columns may have any name
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own, t = F.col("row").getField(id), F.coalesce(F.col("row").getField(text), F.lit(""))
    named = df.select(row.alias("row")).select("row", F.xxhash64(own, t).alias("d1"), F.xxhash64(F.lit(1), own, t).alias("d2"))
    return named.join(stay, ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("row.*")
