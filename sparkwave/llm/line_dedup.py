"""Line deduplication through a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends and with A-Z in lower
case. Documents become lists of distinct 128-bit hashes of their keys; the hashes are
counted over all documents and dealt into shards by their high bits. Each shard is a
minimal perfect hash with a fingerprint and a saturated count per line. The documents'
hashes are sent to the shards and probe the arrays there; only hashes that must go
come back, so line texts are never shuffled or joined. Whole texts move once, to meet
the list of their own lines that go (a document without such lines meets none).

The ``HOT_LINES`` most frequent lines are known to every task and do not travel, so
no shard is filled by one line. All that is collected has that bound.

Defined results: a null or empty text is one empty line; an empty key never goes.
Every row of the input is a document, so repeated rows count as often as they occur.
Null ids are kept. Two keys count as one if their 128-bit hashes are equal. Columns
other than the id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.perfect_hash import PerfectHash
from sparkwave.plans.lineage import cut

MIN_CHARS = 1
MIN_DOCUMENTS = 10
SHARD_LINES = 1 << 18
HOT_LINES = 1000
_SPACE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the line's key; None if the key is too short to go."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8")) < min_chars):
        return None
    return blake2b(key, digest_size=16).digest()


def _pairs(hashes: bytes) -> np.ndarray:
    return np.frombuffer(hashes, "<i8").reshape(-1, 2)


def _document(id: str, t: str) -> list[Column]:
    """128 bits that name a document by its id and text; equal rows share the name and its result."""
    return [F.xxhash64(id, t).alias("d1"), F.xxhash64(F.lit(1), id, t).alias("d2")]


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64())]))
        for batch in batches:
            parts, ends = [], [0]
            for t in batch["t"]:
                found = {line_hash(x, min_chars) for x in t.as_py().encode("utf-8").split(b"\n")}
                found.discard(None)
                parts.append(b"".join(sorted(found)))
                ends.append(ends[-1] + len(found))
            flat = _pairs(b"".join(parts))
            items = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["hi", "lo"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items).cast(kind)
            yield pa.RecordBatch.from_arrays([batch["d1"], batch["d2"], lists], ["d1", "d2", "lines"])

    return map_batches(docs.select(*_document("id", "t"), "t"), run, "d1 long, d2 long, lines array<struct<hi: long, lo: long>>")


def _shards(counts: DataFrame, min_documents: int) -> DataFrame:
    """One row per shard: its arrays. Counts saturate where they no longer matter."""
    dtype = np.min_scalar_type(min_documents)

    def build(group: pa.Table) -> pa.Table:
        hi = group["hi"].to_numpy().astype(np.int64).view(np.uint64)
        lo = group["lo"].to_numpy().astype(np.int64).view(np.uint64)
        n = np.minimum(group["n"].to_numpy(), min_documents).astype(dtype)
        made = PerfectHash.build(hi, lo, n).to_bytes()
        return pa.table({"shard": group["shard"].slice(0, 1), "arrays": pa.array([made], pa.binary())})

    return counts.groupBy("shard").applyInArrow(build, "shard int, arrays binary")


def _probe(probes: DataFrame, shards: DataFrame, min_documents: int) -> DataFrame:
    """The rows of ``probes`` whose line is found in enough documents. A shard's arrays come before its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, arrays = None, None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            starts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
            for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
                part = batch.slice(a, b - a)
                if shard[a] != number:
                    number, arrays = shard[a], PerfectHash.from_bytes(part["arrays"][0].as_py())
                    part = part.slice(1)
                hi, lo = (part[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
                gone = pa.array(arrays.lookup(hi, lo) >= min_documents)
                yield pa.RecordBatch.from_arrays([part[c].filter(gone) for c in names], names)

    names = ["d1", "d2", "hi", "lo"]
    none = [F.lit(0).cast("long").alias(c) for c in names]
    both = shards.select("shard", *none, "arrays", F.lit(0).alias("turn")).unionByName(
        probes.select("shard", *names, F.lit(None).cast("binary").alias("arrays"), F.lit(1).alias("turn"))
    )
    dealt = both.repartition("shard").sortWithinPartitions("shard", "turn").drop("turn")
    return map_batches(dealt, run, "d1 long, d2 long, hi long, lo long")


def drop_common_lines(
    df: DataFrame, id: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_lines``, ``n_dropped`` and ``kept`` (the text of the lines that stay)."""
    docs = df.select(F.col(id).alias("id"), text_of(text).alias("t"))
    hashed = cut(_hashed(docs, min_chars))
    lines = hashed.select("d1", "d2", F.explode("lines").alias("line")).select("d1", "d2", "line.*")
    counts = cut(lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")))
    hot = counts.where(F.col("n") >= min_documents).orderBy(F.desc("n"), "hi", "lo").limit(HOT_LINES).collect()
    known = frozenset(np.array([r["hi"], r["lo"]], "<i8").tobytes() for r in hot)
    shard = F.pmod("hi", F.lit(-(-counts.count() // SHARD_LINES) or 1)).cast("int").alias("shard")
    shards = cut(_shards(counts.select("*", shard), min_documents))
    cold = F.lit(True) if not hot else ~F.struct("hi", "lo").isin([F.struct(F.lit(r["hi"]), F.lit(r["lo"])) for r in hot])
    gone = _probe(lines.select("*", shard).where(cold), shards, min_documents)
    lists = gone.groupBy("d1", "d2").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for t, found in zip(batch["t"], batch["gone"], strict=True):
                own = found.values
                more = {x.tobytes() for x in np.column_stack([own.field("hi"), own.field("lo")]).astype("<i8")} if own else ()
                every = t.as_py().encode("utf-8").split(b"\n")
                stay = []
                for line in every:
                    h = line_hash(line, min_chars)
                    if h is None or not (h in known or h in more):
                        stay.append(line)
                total.append(len(every))
                dropped.append(len(every) - len(stay))
                kept.append(b"\n".join(stay).decode("utf-8"))
            made = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch["id"], *made], ["id", "n_lines", "n_dropped", "kept"])

    met = docs.select("*", *_document("id", "t")).join(lists, ["d1", "d2"], "left").select("id", "t", "gone")
    kind = df.schema[id].dataType.simpleString()
    return map_batches(met, run, f"id {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("id", id)
