"""Runs registered queries against DuckDB on the same tables: ``python tests/oracle.py [dir] [name…]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((str(k), str(plain(x))) for k, x in v.items())
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v if v is None else str(v)


def bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(str([plain(r[k]) for k in order]) for r in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None) -> str:
    """Empty if both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    ours = bag(df.columns, df.collect())
    if sql is None:
        return "" if sum(ours[1].values()) else "no rows"
    cur = connect(sf_dir).execute(sql)
    theirs = bag([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
        return (
            f"{sum(ours[1].values())} rows / {sum(theirs[1].values())}; "
            f"only ours {sum(extra.values())} {list(extra)[:3]}; only SQL {sum(missing.values())} {list(missing)[:3]}"
        )
    return "" if sum(ours[1].values()) else "no rows"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    sql = entry.oracle_sql()
    spark = session()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict = compare(spark, folder, name, fn, sql.get(name))
        except Exception as e:  # noqa: BLE001 - reported, and counted as a failure
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in sql else '(no SQL)'} {verdict}", flush=True)
    print("failures:", bad)
