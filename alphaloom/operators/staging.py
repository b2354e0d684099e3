"""Tables written once to the shared checkpoint folder and read back.

Multi-pass operators read their input several times; a staged table is computed once,
survives the loss of executors, keeps column pruning and filter pushdown, and tells the
optimizer its true size, so that small ones are broadcast and large ones are not.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import scratch_path


CODEC = "spark.alphaloom.stagedCodec"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = threading.Lock(), 0, "false"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of queries that end in here; otherwise they stay until the driver collects
    garbage. The setting is the session's, so the last of several threads restores it."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.set(_CLEANUP, _before)


def stage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and return the stored table; the shuffles that led to it are dropped.

    Tables are compressed with ``codec``, else the session's ``CODEC``, else zstd.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    with shuffles_dropped(spark):
        df.write.option("compression", codec or spark.conf.get(CODEC, "zstd")).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def per_date(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``table`` with a broadcast hint where it has at most one row per calendar date; scenario columns may multiply
    that, so with them its size decides at run time."""
    return table if list(by) else F.broadcast(table)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``stage`` wrote and that nothing reads any more."""
    remove(table.sparkSession, table.staged_path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder under the checkpoint folder."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been completed."""
    context = spark.sparkContext
    done = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done)
