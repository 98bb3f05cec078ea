"""Deciding at build time whether a table is small enough to copy everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after counting that it has few rows.

    The count stops at ``rows + 1``. A larger table is returned without a hint,
    so the join shuffles and adaptive execution splits its skewed partitions.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def crowded(counts: DataFrame, keys: Sequence[str], n: str, most: int) -> DataFrame | None:
    """The keys of ``counts`` whose ``n`` is above ``most``; None if there are none.

    Up to ``BROADCAST_ROWS`` of them become a literal table, more stay an ordinary one.
    """
    found = counts.where(F.col(n) > most).select(*keys)
    rows = found.limit(BROADCAST_ROWS + 1).collect()
    if not rows:
        return None
    return F.broadcast(found.sparkSession.createDataFrame(rows, found.schema)) if len(rows) <= BROADCAST_ROWS else found
