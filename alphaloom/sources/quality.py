"""Data-quality summary of a bundle and its gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def non_null_share(column: str):
    return F.avg(F.col(column).isNotNull().cast("int"))


def table_summary(df: DataFrame, name: str, ratios: Sequence[str], key: str = "ts_code") -> DataFrame:
    """Long table (table_name, measure, value): rows, distinct codes and non-null shares."""
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.countDistinct(key).cast("double").alias("codes"),
        *[non_null_share(c).alias(f"{c}_non_null") for c in ratios],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in one.columns])
    return one.select(F.lit(name).alias("table_name"), F.inline(pairs))


def bundle_summary(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_summary(df, name, ratios) for name, (df, ratios) in tables.items()])


def quality_gate(summary: DataFrame, minimum: float = 0.05) -> None:
    """Raise ``ValueError`` when a non-null share is below ``minimum``. The summary has a handful of rows."""
    bad = summary.where(F.col("measure").endswith("_non_null") & (F.coalesce("value", F.lit(0.0)) < minimum))
    names = [f"{x.table_name}.{x.measure}" for x in bad.collect()]
    if names:
        raise ValueError(f"columns nearly empty: {sorted(names)}")
