"""Token counts through a compiled transducer and composed chunk maps.

A long text is cut into chunks. The map of a chunk says what any state before it
leads to: the transducer is back in its first state at every border between a
character and white space, so the map is the text before the first border (run
from whatever state comes in), the tokens between the first and last border, and
the text after the last one, which names the outgoing state. Maps compose
associatively; those of one text are composed in pairs, as a prefix scan does.

Documents are scanned once and the counts need no shuffle, apart from the short
maps of texts of more than one chunk.

Defined results: a null text counts as empty and has no tokens. Rows are counted
one by one, so null or repeated ids are kept as they are. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.bpe_transducer import transducer
from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.segments import PRE_TOKEN, Cache, between, first_border, last_border, segments
from sparkwave.plans.lineage import cut

CHUNK_CHARS = 1 << 16
#: A chunk map: text before the first border, tokens between the borders (None without a border), text after the last.
Map = tuple[str, int | None, str]


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str):
        self.transducer = transducer(path)
        self.special = self.transducer.v.special
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.cache = Cache(self._segment)

    def _segment(self, segment: str) -> int:
        return sum(self.transducer.count(w.encode("utf-8")) for w in self.pre_tokens(segment))

    def count(self, text: str) -> int:
        get = self.cache.__getitem__
        return sum(1 if special else sum(map(get, segments(piece))) for piece, special in between(text, self.special))

    def map_of(self, chunk: str) -> Map:
        first = first_border(chunk)
        if first is None:
            return chunk, None, ""
        last = last_border(chunk)
        return chunk[:first], self.count(chunk[first:last]), chunk[last:]

    def compose(self, a: Map, b: Map) -> Map:
        if a[1] is None:
            joined = a[0] + b[0]
            # the seam can be a border itself
            return self.map_of(joined) if b[1] is None else self._lead(joined, b)
        if b[1] is None:
            return self._trail(a, a[2] + b[0])
        head, middle, tail = self._trail((a[0], a[1], ""), a[2] + b[0])
        return head, middle + self.count(tail) + b[1], b[2]

    def _lead(self, text: str, b: Map) -> Map:
        head, middle, tail = self.map_of(text)
        return (head, b[1], b[2]) if middle is None else (head, middle + self.count(tail) + b[1], b[2])

    def _trail(self, a: Map, text: str) -> Map:
        """``text`` begins at the last border of ``a``."""
        last = last_border(text)
        if not last:
            return a[0], a[1], text
        return a[0], a[1] + self.count(text[:last]), text[last:]

    def total(self, maps: list[Map]) -> int:
        """Compose neighbours until one map is left; the first state comes in and the text ends."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, middle, tail = maps[0]
        return self.count(head) + (middle or 0) + self.count(tail)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One per Python process, so that its caches last over batches and tasks."""
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per row of ``df``: the id, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer`` is the path of a byte-level vocabulary file, present on every machine.
    """

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            heads, counts, tails = [], [], []
            for chunk, only in zip(batch["chunk"], batch["last"], strict=True):
                if only.as_py() == 0:
                    head, middle, tail = "", c.count(chunk.as_py()), ""
                else:
                    head, middle, tail = c.map_of(chunk.as_py())
                heads.append(head)
                counts.append(middle)
                tails.append(tail)
            made = [pa.array(heads, pa.string()), pa.array(counts, pa.int64()), pa.array(tails, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), *made], [*kept, "head", "middle", "tail"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            totals = [c.total([(m["head"], m["middle"], m["tail"]) for m in row]) for row in batch["maps"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], pa.array(totals, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kept = ("rid", "id", "n_bytes", "pos", "last")
    t = F.col("t")
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).alias("id"), text_of(text).alias("t"))
    pieces = F.when(F.octet_length(t) <= chunk_chars, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{chunk_chars}}}"), 0))
    chunks = docs.select("rid", "id", F.octet_length(t).cast("long").alias("n_bytes"), pieces.alias("chunks"))
    rows = chunks.select("rid", "id", "n_bytes", (F.size("chunks") - 1).alias("last"), F.posexplode("chunks").alias("pos", "chunk"))
    id_type = df.schema[id].dataType
    schema = f"rid long, id {id_type.simpleString()}, n_bytes long, pos int, last int, head string, middle long, tail string"
    mapped = cut(map_batches(rows, maps, schema))
    short = mapped.where("last = 0").select("id", "n_bytes", F.col("middle").alias("n_tokens"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "head", "middle", "tail")))
    long = mapped.where("last > 0").groupBy("rid").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), ordered.alias("maps"))
    long = map_batches(long.select("id", "n_bytes", "maps"), joined, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
    return short.unionByName(long).withColumnRenamed("id", id)
