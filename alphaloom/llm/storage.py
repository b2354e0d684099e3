"""Staged tables: shuffle files go as soon as the table is written, and readers and Python get batches of few rows; small tables from the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from alphaloom.operators.staging import CODEC, stage

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_VECTOR = "spark.sql.parquet.columnarReaderBatchSize"
BATCH_ROWS = 1000  # a batch of whole texts is held several times over, by the executor's JVM and by its Python workers
VECTOR_ROWS = 256  # texts of this many rows are one array in the executor's heap, which grows by doubling


def settle(df: DataFrame) -> DataFrame:
    """``stage(df)`` with quick compression, after which the disk holds the table but not the shuffles that led to it.

    Meanwhile Python workers get at most ``BATCH_ROWS`` rows at once, and Parquet is read ``VECTOR_ROWS`` rows at once.
    """
    conf = df.sparkSession.conf
    before = {_BATCH: conf.get(_BATCH), _VECTOR: conf.get(_VECTOR), CODEC: conf.get(CODEC, "zstd")}
    rows = int(before[_BATCH])
    try:
        conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        conf.set(_VECTOR, str(min(int(before[_VECTOR]), VECTOR_ROWS)))
        conf.set(CODEC, "snappy")
        return stage(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def small_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A table of a few rows from the driver; unlike rows given as tuples, it starts no Python workers on the executors."""
    return spark.createDataFrame(pa.table({c: pa.array(v, kind) for c, (kind, v) in columns.items()}))
