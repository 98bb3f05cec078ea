"""Packing by power-of-two decomposition.

A document's tokens (with the closing id) are split into pieces whose lengths are
the sequence length and the binary digits of the rest. Each piece is one sequence,
so none crosses documents and, all lengths being powers of two, none needs padding.
Sequences of one length form a bucket: batches drawn from a bucket are rectangular.
The sequence number carries the bucket in its high bits, so every bucket is one
range of numbers; below them it numbers the rows of the partitions.

One scan and no shuffle; memory is bounded by one Arrow batch of documents.

Defined results: a null or empty text is the closing id alone, one piece of length 1.
Repeated rows are packed as often as they occur, null ids are kept. Columns other
than the id and the text are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.bpe_transducer import byte_letters
from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.segments import PRE_TOKEN, WHITE

SEQUENCE_TOKENS = 1024
END_ID = 0
_NUMBER_BITS = 57


class TokenIds:
    """The ids that the ``tokenizers`` library gives for a vocabulary file.

    A byte-level vocabulary whose ids follow the order of its merges is the same
    machine in ``tiktoken``, which is about five times faster; other files, and
    texts with a very long stretch without white space, use the library itself.
    """

    LONG = 4096

    def __init__(self, path: str):
        self.path = path
        self.fast = _as_ranks(path)
        self.long = re.compile(f"[^{WHITE}]{{{self.LONG}}}|[{WHITE}]{{{self.LONG}}}")

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_padding()
        library.no_truncation()
        return library

    def encode(self, text: str, end: int | None = None) -> np.ndarray:
        if self.fast is None or self.long.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, allowed_special="all", disallowed_special=())
        if end is not None:
            ids.append(end)
        return np.array(ids, "<u4")


def _as_ranks(path: str):
    """The vocabulary for ``tiktoken``, or None where the two libraries could differ."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    by_bytes = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    special = {t["content"]: t["id"] for t in added}
    alone = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    if not (by_bytes and plain and alone and spec.get("normalizer") is None and spec.get("post_processor") is None):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    letters = byte_letters()
    if any(y <= x for x, y in zip(order, order[1:])) or order[0] < len(letters) or len(order) + len(letters) != len(model["vocab"]):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def lengths(n: int, longest: int) -> list[int]:
    """``n`` as a sum: as many ``longest`` as fit, then the binary digits of the rest, largest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``bucket``, ``sequence_id``, ``offset``.

    ``bucket`` is the binary logarithm of the length. ``sequence_tokens`` must be a power of two.
    """
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_ids(tokenizer)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                row, start, length, ids, total = [], [], [], [], []
                for k, x in enumerate(part["t"]):
                    tokens = t.encode(x.as_py(), end_id)
                    at = 0
                    for n in lengths(len(tokens), sequence_tokens):
                        row.append(k)
                        start.append(at)
                        length.append(n)
                        ids.append(tokens[at : at + n].tobytes())
                        total.append(len(tokens))
                        at += n
                made = [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(row, pa.int64())), *made], ["id", "start", "length", "ids", "doc_tokens"])

    kind = df.schema[id].dataType.simpleString()
    docs = df.select(F.col(id).alias("id"), text_of(text).alias("t"))
    out = map_batches(docs, pieces, f"id {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int")
    number = F.shiftleft(bucket.cast("long"), _NUMBER_BITS) + F.monotonically_increasing_id()
    numbered = out.select("*", bucket.alias("bucket"), number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.withColumnRenamed("id", id)


def write_buckets(packed: DataFrame, folder: str) -> None:
    """One folder per sequence length."""
    packed.write.partitionBy("bucket").parquet(folder)
