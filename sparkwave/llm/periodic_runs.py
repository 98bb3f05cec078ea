"""Periodic runs of words, found in tiles by scale and stitched.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same) of
at least ``max(24, 3 q)`` words that no neighbouring word extends.

* **Tiles.** Every document is exploded into overlapping tiles for each scale of periods:
  first all periods below ``BASE``, then one octave each. A tile is ten times as long as
  its largest period, a fifth of which overlaps the next tile, so that any ``max(24, 2 q)``
  words of a run lie in one tile, and a document gives rows in proportion to its words
  for each scale that it is long enough for.
* **Solving a tile.** A stretch with period ``q`` matches itself moved by ``q``. Boundaries
  are set so densely that every such match spans the gram behind one of them; grams are
  compared by hash with those at all distances of the octave. Where they agree, the
  Z-functions of the boundary to both sides tell how far the match goes. What is shorter
  than ``max(24, 2 q)`` or has a shorter period is left out (which this length decides,
  by Fine and Wilf), the rest are fragments of runs.
* **Stitching.** Fragments are dealt by document and period. Those of neighbouring tiles
  overlap by ``2 q`` at least, those of different runs by less than ``q``.

Tiles are made and solved in the task that reads the document; only fragments are shuffled.
When runs are brought back to their documents, texts without a run stay where they are: a
bit table of fixed size tells for nearly all of them, however many documents there are.

Defined results: a null or empty text has no words and no runs. Rows that agree in id and
text are one document in ``find_runs``; ``with_runs`` returns each of them. Null ids are
kept. Columns other than the id and the text are left out. Words are compared by hashes
of 64 bits, documents by 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwave.llm.common import map_batches, text_of, words_of
from sparkwave.plans.lineage import cut

#: Words of the shortest run, and how often it holds its period.
LEAST, TIMES = 24, 3
#: Periods below it share the first tiles.
BASE = 128
#: Words of a tile and its overlap, in largest periods.
STEP, OVERLAP = 8, 2
#: Rows of the bit table; each holds 64 bits.
SLOTS = 1 << 16
#: With more shifts than this at one boundary, all values of the Z-functions are made at once.
FEW = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(29)


def z_function(x: list) -> list[int]:
    """At each place, how far what begins there agrees with the beginning."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _all_reaches(w: np.ndarray, b: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For shifts 0 to ``most``: how far words from ``b`` on, and words before ``b``, agree with those moved by the shift."""
    forward = z_function(w[b:].tolist())
    forward = np.array((forward + [0] * (most + 1))[: most + 1])
    before, moved = w[:b][::-1].tolist(), w[: b + most][::-1].tolist()
    back = z_function([*before, None, *moved])[b + 1 :]
    # the place of the shift q is that of the q-th word from the end of what lies after the boundary
    reach = np.zeros(most + 1, np.int64)
    for q in range(most + 1):
        place = len(moved) - b - q
        if 0 <= place < len(back):
            reach[q] = min(back[place], b)
    return forward, reach


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    differ = a != b
    at = int(differ.argmax()) if len(differ) else 0
    return at if len(differ) and differ[at] else len(differ)


def _few_reaches(w: np.ndarray, b: int, q: int) -> tuple[int, int]:
    forward = _agree(w[b : len(w) - q], w[b + q :])
    return forward, _agree(w[:b][::-1], w[q : b + q][::-1])


def _prime_parts(q: int) -> list[int]:
    """``q`` divided by each of its prime factors."""
    out, rest, f = [], q, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return [*out, q // rest] if rest > 1 else out


def _octaves(low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of a range of periods: first and end period, words of a gram, words between boundaries."""
    if low < 16:
        yield low, min(16, high), 8, 4
        low = 16
    while low < high:
        yield low, min(2 * low, high), low // 2, low // 2
        low *= 2


def _matches(words: np.ndarray, ends: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(tile, boundary, shifts)`` where grams agree, both in one tile; ``words`` holds the tiles, which end at ``ends``."""
    gram, size = words.view(np.uint64), 1
    for first, end, long, apart in _octaves(low, high):
        while size < long and len(gram) > size:
            gram = (gram[:-size] * _MIX ^ gram[size:]) * _MIX
            gram ^= gram >> _TURN
            size *= 2
        if size < long or len(gram) <= first:
            return
        bounds = (len(gram) - first - 1) // apart + 1
        padded = np.concatenate([gram, np.zeros(end - first, np.uint64)])
        moved = np.lib.stride_tricks.sliding_window_view(padded[first:], end - first)[: bounds * apart : apart]
        bound, shift = np.nonzero(moved == gram[: bounds * apart : apart][:, None])
        b, q = bound * apart, shift + first
        tile = np.searchsorted(ends, b, "right")
        inside = b + q + long <= ends[tile]
        b, q, tile = b[inside], q[inside], tile[inside]
        edges = [*np.flatnonzero(np.diff(b, prepend=-1)).tolist(), len(b)]
        for begin, stop in zip(edges, edges[1:]):
            yield int(tile[begin]), int(b[begin]), q[begin:stop]


def fragments(tiles: list[np.ndarray], low: int, high: int) -> list[tuple[int, int, int, int]]:
    """``(tile, period, start, end)`` of the stretches with smallest period from ``low`` to ``high`` and ``max(24, 2 period)`` words at least."""
    out: list[tuple[int, int, int, int]] = []
    ends = np.cumsum([len(w) for w in tiles])
    #: for a tile and a period, the place up to which matches are known
    known: dict[int, np.ndarray] = {}
    for tile, at, here in _matches(np.concatenate(tiles), ends, low, high):
        w = tiles[tile]
        at -= int(ends[tile]) - len(w)
        done = known.get(tile)
        if done is None:
            done = known[tile] = np.zeros(high, np.int64)
        here = here[done[here] <= at]
        if len(here) > FEW:
            forward, back = _all_reaches(w, at, int(here[-1]))
            done[here] = at + forward[here] + 1
            start, stop = at - back, at + np.arange(len(forward)) + forward
            for p in here[stop[here] - start[here] >= np.maximum(LEAST, 2 * here)].tolist():
                if not any(start[d] <= start[p] and stop[d] >= stop[p] for d in _prime_parts(p)):
                    out.append((tile, p, int(start[p]), int(stop[p])))
        else:
            for p in here.tolist():
                forward, back = _few_reaches(w, at, p)
                done[p] = at + forward + 1
                s, e = at - back, at + p + forward
                if e - s >= max(LEAST, 2 * p) and not any(np.array_equal(w[s : s + 2 * p - d], w[s + d : s + 2 * p]) for d in _prime_parts(p)):
                    out.append((tile, p, s, e))
    return out


def _key(id: str, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.col(id), text).alias("k1"), F.xxhash64(F.lit("runs"), F.col(id), text).alias("k2")


def _tiles(codes: Column) -> Column:
    """Every tile of a document: its range of periods, its first word and its words."""
    n = F.size(codes)
    # scale 0 has the periods below BASE, scale s those from BASE * 2^(s-1) on
    scales = F.when(n < LEAST, F.array().cast("array<int>")).when(n < TIMES * BASE, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor(F.log2(n / (TIMES * BASE))).cast("int") + 1))

    def of(scale: Column) -> Column:
        high = F.lit(BASE) * F.pow(F.lit(2), scale).cast("int")
        tiles = F.greatest(F.lit(1), F.ceil((n - OVERLAP * high) / (STEP * high)).cast("int"))
        low = F.when(scale == 0, 1).otherwise(high / 2).cast("int")
        tile = lambda k: F.struct(
            low.alias("low"), high.alias("high"), (k * STEP * high).alias("begin"), F.slice(codes, k * STEP * high + 1, (STEP + OVERLAP) * high).alias("codes")
        )
        return F.transform(F.sequence(F.lit(0), tiles - 1), tile)

    return F.flatten(F.transform(scales, of))


def _solved(df: DataFrame, id: str, text: str, words: Column) -> DataFrame:
    """Fragments of all tiles: id, key, period, start and end in the document."""
    kind = df.schema[id].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch["codes"].offsets.to_numpy()
            codes = batch["codes"].values.to_numpy(zero_copy_only=False)
            low, high, begin = (batch[c].to_numpy() for c in ("low", "high", "begin"))
            row, found = [], []
            for scale in np.unique(low).tolist():
                rows = np.flatnonzero(low == scale)
                for k, p, s, e in fragments([codes[ends[k] : ends[k + 1]] for k in rows], scale, int(high[rows[0]])):
                    row.append(int(rows[k]))
                    found.append((p, s + int(begin[rows[k]]), e + int(begin[rows[k]])))
            period, start, end = zip(*found) if found else ((), (), ())
            at = pa.array(row, pa.int64())
            made = [pa.array(x, pa.int32()) for x in (period, start, end)]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("id", "k1", "k2")), *made], ["id", "k1", "k2", "period", "start", "end"])

    keyed = df.select(F.col(id).alias("id"), *_key(id, text_of(text)), F.transform(words, lambda w: F.xxhash64(w)).alias("codes"))
    tiles = keyed.select("id", "k1", "k2", F.inline(_tiles(F.col("codes"))))
    return map_batches(tiles, solve, f"id {kind}, k1 long, k2 long, period int, start int, end int")


def find_runs(df: DataFrame, id: str = "doc_id", text: str = "text", words: Column | None = None) -> DataFrame:
    """One row per run: the id, ``k1`` and ``k2`` (a hash of id and text), ``start`` (number of the first word), ``length`` and ``period``, all in words.

    ``words``: an array made from the id and the text; by default the runs of characters other than ASCII white space.
    """
    solved = _solved(df, id, text, words_of(text_of(text)) if words is None else words)
    pieces = cut(solved).groupBy("k1", "k2", "period", "start", "end").agg(F.first("id").alias("id"))
    place = Window.partitionBy("k1", "k2", "period").orderBy("start", "end")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") + F.col("period") > before, F.lit(True)).cast("int")
    numbered = pieces.select("*", opens.alias("opens")).select("*", F.sum("opens").over(place).alias("number"))
    runs = numbered.groupBy("k1", "k2", "period", "number").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    whole = runs.where(length >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return whole.select(F.col("id").alias(id), "k1", "k2", *[x.cast("long") for x in (F.col("start"), length.alias("length"), F.col("period"))])


def _by_document(runs: DataFrame) -> DataFrame:
    """``runs`` in order, and ``gone``: the stretches that repeat what stands before them, joined where they touch."""
    every = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    listed = runs.groupBy("k1", "k2").agg(every.alias("runs"))
    drops = runs.select("k1", "k2", (F.col("start") + F.col("period")).alias("from"), (F.col("start") + F.col("length")).alias("to"))
    place = Window.partitionBy("k1", "k2").orderBy("from", "to")
    before = F.max("to").over(place.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("from") > before, F.lit(True)).cast("int")
    numbered = drops.select("*", opens.alias("opens")).select("*", F.sum("opens").over(place).alias("number"))
    islands = numbered.groupBy("k1", "k2", "number").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    gone = islands.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("gone"))
    return listed.join(gone, ["k1", "k2"])


def _without(words: Column, gone: Column) -> Column:
    """The words outside the stretches."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda g: g["to"]))
    ends = F.concat(F.transform(gone, lambda g: g["from"]), F.array(F.size(words).cast("long")))
    between = F.zip_with(begins, ends, lambda b, e: F.slice(words, (b + 1).cast("int"), (e - b).cast("int")))
    return F.flatten(between)


def with_runs(df: DataFrame, id: str = "doc_id", text: str = "text", words: Column | None = None) -> DataFrame:
    """One row per row of ``df``: the id, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` holds the words joined by one space, without those that a run has after its first period.
    """
    own = words_of(text_of(text)) if words is None else words
    found = cut(_by_document(cut(find_runs(df, id, text, words))))
    bit, slot = F.expr("shiftleft(1L, cast(k2 & 63 AS int))"), F.pmod("k1", F.lit(SLOTS))
    table = found.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))
    keyed = df.select(F.col(id), F.col(text), *_key(id, text_of(text)))
    marked = keyed.select("*", slot.alias("slot")).join(F.broadcast(table), "slot", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    none = F.array().cast("array<struct<start:long,period:long,length:long>>")
    plain = marked.where(~maybe).select(id, none.alias("runs"), F.array_join(own, " ").alias("collapsed"))
    met = marked.where(maybe).join(found, ["k1", "k2"], "left").select(id, "runs", "gone", own.alias("words"))
    less = F.when(F.col("gone").isNull(), F.col("words")).otherwise(_without(F.col("words"), F.col("gone")))
    cleaned = met.select(id, F.coalesce("runs", none).alias("runs"), F.array_join(less, " ").alias("collapsed"))
    return plain.unionByName(cleaned)
