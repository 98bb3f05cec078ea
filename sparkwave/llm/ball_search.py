"""Ranked lexical search with exact scores over ball trees of sparse vectors.

A document is the vector of ``weight * saturated frequency`` of the searched terms, all
integers, and a searched item the set of its terms, so that a score is an inner product.

* **Vectors.** One scan counts, for every document, all its terms and those that some item
  has. Sums over these rows give the number of documents, all terms and the documents of
  each term, from which weights follow.
* **Trees.** Every task packs its vectors into ball trees of bounded size: a node knows the
  centroid of its documents, the radius of the ball around it that holds them, and how far
  they rise above it along each term.
* **Search.** No document in a ball scores more than the item's product with the centroid
  plus the item's length times the radius, nor more than the sum of its terms' centroids
  and rises (rounded up, so that both stay bounds); the smaller bound counts. Each
  item visits the nodes with the best bound first and stops when the next bound is below
  its k-th score; leaves are scored exactly, in integers.
* **Start.** The k-th score among the documents whose id's hash is divisible by
  ``START_ONE_IN`` is a lower bound of the k-th score of all, which every task starts with.
  It saves visits and rows; the results are those of all documents.

Every task returns k rows per item at most; the best k of them are the result. Items are
searched in blocks of about ``BLOCK_TERMS`` terms, one pass over the documents each, which
bounds what the driver and each task hold.

Defined results: null and empty texts have no terms, and are found by nothing and find
nothing. Rows are documents, so repeated ids and repeated items are each ranked by
themselves; equal scores go by ascending id, null ids last. Other columns are left out.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwave.llm.common import map_batches, text_of
from sparkwave.plans.lineage import cut, discard

#: Fixed value: what terms consist of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
BLOCK_TERMS = 16_384
#: Documents and entries of a tree, and documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 8192, 2_000_000, 64
START_ONE_IN = 32

_TERMS = re.compile(TERM).findall
_LOWER = {c: c + 32 for c in range(65, 91)}


def counted(text: str) -> tuple[Counter, int]:
    """How often each term occurs, with A-Z lower-cased, and how many terms there are."""
    found = _TERMS(text)
    counts: Counter = Counter()
    for term, n in Counter(found).items():
        counts[term.lower() if term.isascii() else term.translate(_LOWER)] += n
    return counts, len(found)


class Items:
    """The searched items of a block: their ids and, as numbers of terms, their distinct terms."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.terms, self.number = [], [], {}
        for id, text in rows:
            found, _ = counted(text)
            if found:
                self.ids.append(id)
                self.terms.append(np.array([self.number.setdefault(t, len(self.number)) for t in found], np.int64))

    def weigh(self, documents: int, holding: dict[int, int]) -> np.ndarray:
        n = 2 * documents + 2
        return np.array([math.floor(1000 * math.log(n / (2 * holding.get(k, 0) + 1))) for k in range(len(self.number))], np.int64)


class Tree:
    """A ball tree over sparse rows of non-negative integers."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray, dims: int):
        self.dims = dims
        self.start, self.term, self.value = start, term, value
        self.real = value.astype(np.float64)
        rows = len(start) - 1
        # rows without an entry would upset reduceat; there are none
        self.square = np.add.reduceat(self.real * self.real, start[:-1]) if rows else np.zeros(0)
        self.centroid, self.radius, self.top, self.children, self.docs = [], [], [], [], []
        self._grow(np.arange(rows))

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries, and where each document begins among them."""
        size = self.start[docs + 1] - self.start[docs]
        begin = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.start[docs] - begin, size), begin

    def _distances(self, docs: np.ndarray, at: np.ndarray, begin: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances to a point, not below the true ones."""
        inner = np.add.reduceat(point[self.term[at]] * self.real[at], begin)
        square = float(point @ point)
        most = (self.dims + 16) * 2.0**-52 * (self.square[docs] + 2 * inner + square)
        return np.maximum(self.square[docs] - 2 * inner + square, 0) + most

    def _grow(self, docs: np.ndarray) -> int:
        node = len(self.radius)
        at, begin = self._entries(docs)
        centre = np.bincount(self.term[at], weights=self.real[at], minlength=self.dims) / len(docs)
        away = self._distances(docs, at, begin, centre)
        self.centroid.append(centre)
        self.radius.append(math.sqrt(float(away.max())) * (1 + 2.0**-50))
        top = np.zeros(self.dims, np.int64)
        np.maximum.at(top, self.term[at], self.value[at])
        self.top.append(top)
        self.children.append(())
        self.docs.append(docs)
        if len(docs) > LEAF:
            one = self._dense(docs[int(away.argmax())])
            from_one = self._distances(docs, at, begin, one)
            other = self._dense(docs[int(from_one.argmax())])
            nearer = from_one - self._distances(docs, at, begin, other)
            # at the middle between the two ends, but not so that a side is nearly empty
            few = max(1, len(docs) // 16)
            cut_at = min(max(int((nearer < 0).sum()), few), len(docs) - few)
            order = np.argpartition(nearer, cut_at)
            self.children[node] = (self._grow(docs[order[:cut_at]]), self._grow(docs[order[cut_at:]]))
        return node

    def _dense(self, doc: int) -> np.ndarray:
        out, own = np.zeros(self.dims), slice(self.start[doc], self.start[doc + 1])
        out[self.term[own]] = self.real[own]
        return out

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For every node, a number that no document in it exceeds."""
        inner = self._centroids[:, terms].sum(axis=1)
        most = (inner + math.sqrt(len(terms)) * self._radii) * (1 + (len(terms) + 16) * 2.0**-52)
        return np.minimum(np.floor(most) + 1, self._tops[:, terms].sum(axis=1))

    def finish(self) -> Tree:
        self._centroids, self._radii, self._tops = np.array(self.centroid), np.array(self.radius), np.array(self.top)
        self.centroid, self.top = [], []
        self.leaves = {k: self._entries(np.asarray(d)) for k, d in enumerate(self.docs) if not self.children[k]}
        return self

    def scores(self, leaf: int, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents; ``wanted`` is 1 for the item's terms and 0 for others."""
        at, begin = self.leaves[leaf]
        return np.add.reduceat(self.value[at] * wanted[self.term[at]], begin)


class Best:
    """The k best documents of an item so far; ``least`` is the score that a further one must have."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, max(1, least), []

    def add(self, scores: np.ndarray, ids: list) -> None:
        for j in np.flatnonzero(scores >= self.least).tolist():
            self.rows.append((-int(scores[j]), ids[j] is None, ids[j]))
        if len(self.rows) >= 4 * self.k:
            self.trim()

    def trim(self) -> None:
        self.rows.sort(key=lambda r: r[:2] if r[1] else r)
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def search(tree: Tree, ids: list, items: list[np.ndarray], best: list[Best]) -> int:
    """Add the tree's documents to the items' best ones; returns how many leaves were scored."""
    visited = 0
    wanted = np.zeros(tree.dims, np.int64)
    for terms, found in zip(items, best, strict=True):
        bound = tree.bounds(terms).tolist()
        wanted[terms] = 1
        agenda = [(-bound[0], 0)]
        while agenda and -agenda[0][0] >= found.least:
            _, node = heapq.heappop(agenda)
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= found.least:
                        heapq.heappush(agenda, (-bound[child], child))
            else:
                visited += 1
                scores = tree.scores(node, wanted)
                if scores.max() >= found.least:
                    found.add(scores, [ids[d] for d in tree.docs[node]])
                    found.trim()
        wanted[terms] = 0
    return visited


def _vectors(docs: DataFrame, id: str, text: str, number: dict[str, int]) -> DataFrame:
    """Per document with terms: its id, all its terms' count, and the numbers and counts of searched terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sizes, ends, terms, times = [], [], [0], [], []
            for k, t in enumerate(batch["t"]):
                counts, n = counted(t.as_py())
                if n:
                    row.append(k)
                    sizes.append(n)
                    own = counts.keys() & number.keys()
                    terms.extend(number[x] for x in own)
                    times.extend(counts[x] for x in own)
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "times"])

    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("id"), text_of(text).alias("t"))
    return map_batches(texts, count, f"id {kind}, n long, terms array<int>, times array<int>")


def _found(vectors: DataFrame, items: Items, weights: np.ndarray, documents: int, terms: int, k: int, least: list[int]) -> DataFrame:
    """The k best documents of each item in each task: number of the item, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        parts: list[tuple] = []

        def flush() -> None:
            ids = [i for p in parts for i in p[0]]
            size = np.concatenate([p[1] for p in parts])
            term, value = (np.concatenate([p[c] for p in parts]) for c in (2, 3))
            tree = Tree(np.concatenate([[0], np.cumsum(size)]), term, value, len(weights)).finish()
            search(tree, ids, items.terms, best)
            parts.clear()

        rows = entries = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(batch["terms"].offsets.to_numpy()).astype(np.int64)
            m = 50 + 50 * batch["n"].to_numpy() * documents // terms
            term = batch["terms"].flatten().to_numpy().astype(np.int64)
            times = batch["times"].flatten().to_numpy().astype(np.int64)
            value = weights[term] * (1_000_000_000 * times // (1000 * times + 20 * np.repeat(m, size)))
            parts.append((batch["id"].to_pylist(), size, term, value))
            rows, entries = rows + batch.num_rows, entries + len(term)
            if rows >= TREE_DOCS or entries >= TREE_ENTRIES:
                flush()
                rows = entries = 0
        if parts:
            flush()
        out = []
        for j, b in enumerate(best):
            b.trim()
            out += [(j, r[2], -r[0]) for r in b.rows]
        item, ids, score = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, id_type), pa.array(score, pa.int64())], ["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(vectors.schema["id"].dataType)
    kind = vectors.schema["id"].dataType.simpleString()
    return map_batches(vectors.where(F.size("terms") > 0), run, f"item int, id {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = BEST) -> DataFrame:
    """One row per item and found document: ``item``, ``rank`` (from 1), ``id`` and ``score``.

    The score sums, over the item's distinct terms, ``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with
    ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 50 + (50 * n * N) div L``.
    """
    asked = items.select(F.col(item).alias("item"), text_of(item_text).alias("t"))
    size = asked.agg(F.coalesce(F.sum(F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_TERMS))
    item_type = items.schema[item].dataType.simpleString()
    parts = []
    for block in range(blocks):
        of_block = asked.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block)
        parts.append(_rank_block(docs, Items([tuple(r) for r in of_block.collect()]), id, text, k, f"number int, item {item_type}"))
    place = Window.partitionBy("block", "number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    every = reduce(DataFrame.unionByName, [p.withColumn("block", F.lit(b)) for b, p in enumerate(parts)])
    ranked = every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


def _rank_block(docs: DataFrame, items: Items, id: str, text: str, k: int, schema: str) -> DataFrame:
    spark = docs.sparkSession
    vectors = cut(_vectors(docs, id, text, items.number))
    documents, terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row per term of the block at most
    holding = {r[0]: r[1] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = items.weigh(documents, holding)
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(START_ONE_IN)) == 0)
    early = _found(some, items, weights, documents, terms, k, [0] * len(items.ids))
    place = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = early.withColumn("place", F.row_number().over(place)).where(F.col("place") == k).select("item", "score")
    least = [0] * len(items.ids)
    for number, score in kth.collect():
        least[number] = score
    found = cut(_found(vectors, items, weights, documents, terms, k, least).withColumnRenamed("item", "number"))
    discard(vectors)
    names = spark.createDataFrame(list(enumerate(items.ids)), schema)
    return found.join(F.broadcast(names), "number")
