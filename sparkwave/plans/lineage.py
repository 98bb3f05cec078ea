"""Cutting lineage in iterative jobs, on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster.

    Only a local-mode session (tests, a laptop) that names none gets a temporary
    folder; on a cluster a missing setting is an error, because a folder on one
    machine is lost with that machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="sparkwave-checkpoint-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Computes ``df`` once (an RDD checkpoint would compute its last stage twice),
    survives the loss of executors, and gives later joins the true size.
    """
    where = shared_folder(df.sparkSession, "table")
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out._written_to = where
    return out


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """As ``cut``, and written in buckets of ``key``, so that what is put together by it later does not move.

    Rows are best dealt by ``key`` before: a task writes a file for every bucket it has rows of.
    """
    spark = df.sparkSession
    where = shared_folder(spark, "table")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", where).saveAsTable(name)
    out = spark.table(name)
    out._written_to = where
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``; nothing that is still to run may read it."""
    where = getattr(df, "_written_to", None)
    if where is not None:
        remove(df.sparkSession, where)


def _file_system(spark: SparkSession, folder: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote; one that is not there is no error."""
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that is not there yet; False when someone else has made it."""
    files, where = _file_system(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as failed:
        if files.exists(where):
            return False
        raise failed
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def names_in(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names in a folder with the time of their last change (milliseconds); none when it is not there."""
    files, path = _file_system(spark, folder)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in files.globStatus(path.suffix("/*")) or [])


def written_numbers(spark: SparkSession, folder: str, name: str = "batch") -> list[int]:
    """The numbers of the completely written tables ``name=<number>`` in a folder, in order. Only names are read."""
    files, path = _file_system(spark, folder)
    tables = [s.getPath() for s in files.globStatus(path.suffix(f"/{name}=*/_SUCCESS")) or []]
    return sorted(int(t.getParent().getName().split("=")[1]) for t in tables)
