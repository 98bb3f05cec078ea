"""Toxicity: cumulative-link ordinal regression on sparse word features.

A text has a severity grade from 0 (clean) to the highest. Features are the distinct
words and the beginnings of longer ones. One weight per feature is shared by all thresholds: P(grade > k) = sigmoid(w . x - threshold k), with ordered
thresholds. The expected severity is the sum of these probabilities over k; a text
is rejected when grade 0 is less likely than not.

Labels often say only toxic or not. Grades of toxic rows are then made from the
labels: a first fit with one threshold finds marker words, and a toxic row's grade
is the number of distinct markers in it, 1 at least and ``GRADES`` - 1 at most.

The model is fitted on a bounded sample on the driver; scoring needs no shuffle, and
each task gets the words with non-zero weight, at most as many as the sample holds.

Defined results: a null or empty text has no words and is scored by the thresholds
alone. Without labelled rows nothing is rejected and severity is 0. Rows are scored
one by one; null and repeated ids stay, other columns stay.
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
from pyspark.sql import types as T

from sparkwave.llm.common import map_batches
from sparkwave.llm.linear import Ftrl, labelled_sample, sigmoid
from sparkwave.llm.segments import Cache
from sparkwave.plans.lineage import cut

MAX_LABELLED = 20_000
GRADES = 4
EPOCHS = 12
#: Features of fewer sample rows than this are not learned.
MIN_ROWS = 3
#: A word is a marker when its weight is at least this share of the largest one.
MARKER_SHARE = 0.25
PREFIXES = (5, 7)
_words = re.compile(r"[^\W\d_]+").findall


def _hashes(word: str) -> bytes:
    """The word and its longer beginnings, each as 32 bits."""
    parts = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return b"".join(zlib.crc32(p.encode("utf-8", "surrogatepass")).to_bytes(4, "little") for p in parts)


_cache = Cache(_hashes, limit=30_000)


def features(text: str) -> np.ndarray:
    """Distinct hashes (32 bits) of the words in lower case and of their beginnings."""
    return np.unique(np.frombuffer(b"".join(map(_cache.__getitem__, set(_words(text.lower())))), "<u4"))


@dataclass
class Model:
    """Words with non-zero weight in ascending order, their weights, and the thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        found = features(text)
        at = np.searchsorted(self.words, found)
        at[at == len(self.words)] = 0
        hit = self.words[at] == found if len(self.words) else np.zeros(len(found), bool)
        return np.where(np.isinf(self.thresholds), 0.0, sigmoid(float(self.weights[at[hit]].sum()) - self.thresholds))


def _descend(rows: list[np.ndarray], grades: np.ndarray, size: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds: one update per row and epoch."""
    learner = Ftrl(size, alpha=1.0, l1=8.0, l2=0.01)
    thresholds = 1.0 + np.arange(top, dtype=float)
    spent = np.ones(top)
    for _ in range(EPOCHS):
        for at, grade in zip(rows, grades, strict=True):
            w = learner.weights(at)
            total = w.sum()
            # P(grade) is the difference of two neighbouring curves; both ends pull on the score
            p = np.concatenate(([1.0], sigmoid(total - thresholds), [0.0]))
            slope = p * (1.0 - p)
            chance = max(p[grade] - p[grade + 1], 1e-9)
            push = np.zeros(top)
            if grade > 0:
                push[grade - 1] = slope[grade] / chance
            if grade < top:
                push[grade] -= slope[grade + 1] / chance
            learner.update(at, np.full(len(at), -push.sum()), w)
            push = np.clip(push, -5.0, 5.0)
            spent += push * push
            thresholds -= 0.5 * push / np.sqrt(spent)
            thresholds = np.maximum.accumulate(thresholds + 1e-6 * np.arange(top))
    return learner.weights(), thresholds


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", grades: int = GRADES, most: int = MAX_LABELLED) -> Model:
    """Learn from at most ``most`` labelled rows. A label above 1 is taken as the grade itself.

    Rows of a feature are counted in Spark; the driver gets those of the learned ones only, as places in their list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).view("<i4") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(found, pa.list_(pa.int32()))], ["id", "label", "words"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [_places(shared.value, x.values.to_numpy().view("<u4")).tobytes() for x in batch["words"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(places, pa.binary())], ["id", "label", "places"])

    sample = labelled_sample(df, labels, id, text, label, most).select("id", "label", "text")
    kind = sample.schema["id"].dataType.simpleString()
    found = cut(map_batches(sample, run, f"id {kind}, label int, words array<int>"))
    often = found.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= MIN_ROWS).select("word").toArrow()
    words = np.sort(often["word"].to_numpy().astype("<i4").view("<u4"))
    shared = df.sparkSession.sparkContext.broadcast(words)
    placed = map_batches(found, place, f"id {kind}, label int, places binary").orderBy(F.xxhash64("id"), "id").select("label", "places").toArrow()
    rows = [np.frombuffer(x.as_buffer(), "<i4") for x in placed["places"]]
    return learn(words, rows, np.array(placed["label"].to_pylist(), int), grades)


def _places(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where those of ``found`` that are in ``words`` stand there; both are in ascending order."""
    at = np.searchsorted(words, found)
    at[at == len(words)] = 0
    return (at[words[at] == found] if len(words) else at[:0]).astype("<i4")


def learn(words: np.ndarray, rows: list[np.ndarray], y: np.ndarray, grades: int = GRADES) -> Model:
    """Fit on the features of texts, given by their places in ``words``, and the grades (or 0/1 labels) of the texts."""
    y = np.clip(y, 0, grades - 1)
    if not len(y) or not y.any():
        return Model(np.empty(0, np.uint32), np.empty(0), np.full(grades - 1, np.inf))
    if y.max() == 1 and grades > 2:
        first, _ = _descend(rows, y, len(words), 1)
        marker = first >= max(MARKER_SHARE * first.max(initial=0.0), 1e-9)
        y = np.array([min(grades - 1, max(1, int(marker[at].sum()))) if g else 0 for at, g in zip(rows, y, strict=True)])
    weights, thresholds = _descend(rows, y, len(words), grades - 1)
    kept = weights != 0
    return Model(words[kept], weights[kept], thresholds)


def grade(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with a struct ``out``: ``severity``, ``grade`` (the most likely one) and ``rejected``. A column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])
    columns = [c for c in df.columns if c != out]
    whole = T.StructType([df.schema[c] for c in columns])
    # a row is one value here, so that its columns may have any name
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, likely, rejected = [], [], []
            for t in batch["row"].field(at):
                above = shared.value.above(t.as_py() or "")
                severity.append(float(above.sum()))
                likely.append(int(np.argmax(np.concatenate(([1.0], above)) - np.concatenate((above, [0.0])))))
                rejected.append(bool(above[0] > 0.5))
            made = pa.StructArray.from_arrays([pa.array(severity, pa.float64()), pa.array(likely, pa.int32()), pa.array(rejected)], ["severity", "grade", "rejected"])
            yield pa.RecordBatch.from_arrays([batch["row"], made], ["row", "made"])

    graded = map_batches(rows, run, T.StructType([T.StructField("row", whole), T.StructField("made", result)]))
    return graded.select("row.*", F.col("made").alias(out))
