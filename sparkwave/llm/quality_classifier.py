"""Quality classifier: logistic regression on hashed word n-grams.

Features are unigrams and bigrams of words and of word shapes (``Xx``, ``x%``, a word
repeated), hashed into a fixed number of slots, each occurrence counting one part of
the text's length. Weights come from follow-the-regularised-leader updates over a
bounded sample of labelled rows on the driver; they are an array of fixed size that
every task gets. A score is one sparse dot product per row, without a shuffle.

Defined results: a null text counts as empty; its score is that of the intercept
alone. Without labelled rows every score is 0.5. Rows are scored one by one, null
and repeated ids stay. Labels of null ids, and null labels, teach nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.linear import MAX_LABELLED, Ftrl, labelled_sample, sigmoid
from sparkwave.llm.segments import Cache

SLOT_BITS = 20
EPOCHS = 4
#: Sum of the feature values of a text, per kind of feature.
SCALE = 8.0
THRESHOLD = 0.7
_SHAPES = ((re.compile("[^\\W\\d_]+"), lambda m: "X" if m[0].isupper() else "x"), (re.compile("\\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))


def shape(word: str) -> str:
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return word[:16]


def _hashes(word: str) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))


_cache = Cache(_hashes, limit=30_000)


def slots(text: str) -> np.ndarray:
    """The slot of every feature occurrence; 4 n - 2 of them for n words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    both = np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    raw, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    # a repeated word has a shape of its own
    form[1:][raw[1:] == raw[:-1]] = 1
    kinds = []
    for k, h in enumerate((raw, form)):
        kinds.append(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k))
        kinds.append((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[1:]) * np.uint64(0x165667B19E3779F9) + np.uint64(2 * k + 1))
    mixed = np.concatenate(kinds)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        at = slots(text)
        words = (len(at) + 2) // 4
        return float(sigmoid(self.intercept + (SCALE / words * float(self.weights[at].sum()) if words else 0.0)))


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Model:
    """Learn from at most ``most`` labelled rows; ``labels`` has the ids that may be learned from."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(t.as_py()).astype("<u4").tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(found, pa.binary())], ["id", "label", "slots"])

    sample = labelled_sample(df, labels, id, text, label, most).select("id", "label", "text")
    kind = sample.schema["id"].dataType.simpleString()
    rows = map_batches(sample, features, f"id {kind}, label int, slots binary").orderBy(F.xxhash64("id"), "id").select("label", "slots").toArrow()
    learner = Ftrl(1 << SLOT_BITS, alpha=0.5, l1=0.02, l2=0.5)
    bias = Ftrl(1, alpha=0.1)
    zero = np.zeros(1, np.int64)
    for _ in range(EPOCHS):
        for y, packed in zip(rows["label"].to_pylist(), rows["slots"], strict=True):
            every = np.frombuffer(packed.as_buffer(), "<u4")
            words = max(1, (len(every) + 2) // 4)
            at, times = np.unique(every, return_counts=True)
            x = times * (SCALE / words)
            w, b = learner.weights(at), bias.weights(zero)
            wrong = sigmoid(b[0] + float(w @ x)) - (y > 0)
            learner.update(at, wrong * x, w)
            bias.update(zero, np.array([wrong]), b)
    return Model(learner.weights().astype(np.float32), float(bias.weights(zero)[0]))


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id and ``score``, the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch["t"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores, pa.float64())], ["id", "score"])

    kind = df.schema[id].dataType.simpleString()
    docs = df.select(F.col(id).alias("id"), text_of(text).alias("t"))
    return map_batches(docs, run, f"id {kind}, score double").withColumnRenamed("id", id)
