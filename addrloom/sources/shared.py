"""The folder that the driver and all executors share, and an application's own place in it."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it. Where that is unset a local folder serves, for local masters only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return found.rstrip("/")


_homes: set[str] = set()


def home(spark: SparkSession) -> str:
    """The folder of all that this application keeps for a while; it goes when the driver's interpreter ends."""
    own = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"
    if own not in _homes:
        _homes.add(own)
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(own), spark._jsc.hadoopConfiguration()
        atexit.register(lambda: _dropped(path, conf))
    return own


def _dropped(path, conf) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone before its driver
        path.getFileSystem(conf).delete(path, True)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written once, to a folder or to the application's own, and read back: what follows does not compute them again."""
    path = f"{folder or home(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as a shuffle has: a small file, or one group of rows in it, is read by a single task,
    and work by the row would stay there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a table that is broadcast to where others look it up.
FEW = 200_000


def looked_up(rows: DataFrame, table: DataFrame, on: str | list[str] | Column, how: str = "inner", few: int = FEW) -> DataFrame:
    """rows joined to a table that has each key once. The table is written once; while it has few rows it goes to the rows, so that
    a few keys do not gather them in a few tasks."""
    table = kept(table)
    return rows.join(F.broadcast(table) if table.count() <= few else table, on, how)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if that is absent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(where) if files.exists(where) else []
    return sorted(s.getPath().getName() for s in found if s.isDirectory())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of any file system that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
