"""The list of queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("wave_queries", "spectrum_queries", "case_queries", "function_queries", "sql_queries", "catalog_queries", "sheet_queries", "deck_queries", "stream_queries")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"sparkwave.suite.{m}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over many tasks: a small file is read by one, however much is then made of each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rounded(column: Column | str, digits: int = 6, name: str | None = None) -> Column:
    """Rounded for comparison, without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(name or column) if (name or isinstance(column, str)) else out
