"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write Parquet (default), CSV with header or JSON; ``partition_by`` gives one output per variant."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def save_panel(panel: DataFrame, path: str, date: str = "trade_date") -> str:
    """Research panel partitioned by month, so that date ranges prune files."""
    return save_table(panel.withColumn("month", F.date_format(date, "yyyy-MM")), path, ["month"])


def append_variant(df: DataFrame, path: str, variant: str) -> str:
    """Add one variant's rows to a comparison table as soon as they are known."""
    return save_table(df.withColumn("variant", F.lit(variant)), path, ["variant"], mode="append")


def save_summary(df: DataFrame, path: str) -> str:
    """JSON summary of a small report."""
    return save_table(df, path, fmt="json")
