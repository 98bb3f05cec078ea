"""Helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a character class for Java, RE2 and Python.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a batch that goes to Python; texts can be long, and a batch is held several times over.
BATCH_ROWS = 500
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in small batches, with this package on the path of the Python workers (where no archive of it was shipped).

    The batch size is a setting of the session and stays lowered, as plans read it when they run.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, BATCH_ROWS)
    env = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])

    def run(batches):
        yield from fn(batches)
        # what the allocator keeps for itself would stay with the worker
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
