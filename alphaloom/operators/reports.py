"""Small report tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def importance_summary(importance: DataFrame, top: int = 15) -> DataFrame:
    """Mean and sample standard deviation per feature over windows (a single window has 0), best first."""
    stats = importance.groupBy("feature").agg(F.avg("importance").alias("mean"), F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("std"))
    return stats.orderBy(F.col("mean").desc(), "feature").limit(top)


def unpivot_importance(wide: DataFrame, features: Sequence[str], top: int = 15) -> DataFrame:
    """Column means of a table with one column per feature."""
    means = wide.agg(*[F.avg(c).alias(c) for c in features])
    long = means.unpivot([], list(features), "feature", "mean")
    return long.orderBy(F.col("mean").desc(), "feature").limit(top)


def union_labelled(parts: Sequence[tuple[str, DataFrame]], label: str) -> DataFrame:
    """Stack tables under a label column; absent columns become NULL."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def seed_statistics(runs: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std, coefficient of variation, min and max over seeds."""
    return runs.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.when(F.avg(value) != 0, F.stddev_samp(value) / F.avg(value)).alias("cv"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def wins_over(runs: DataFrame, value: str, baseline: str, label: str, seed: str = "seed") -> DataFrame:
    """Number of seeds in which each scheme beats the baseline scheme."""
    base = runs.where(F.col(label) == baseline).select(seed, F.col(value).alias("_base"))
    won = F.coalesce((F.col(value) > F.col("_base")).cast("int"), F.lit(0))
    return runs.where(F.col(label) != baseline).join(F.broadcast(base), seed, "left").groupBy(label).agg(F.sum(won).alias("wins"), F.count(F.lit(1)).alias("seeds"))


def pivot_metric(table: DataFrame, rows: str, columns: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per named group."""
    return table.groupBy(rows).pivot(columns, list(names)).agg(F.first(value))


def order_by_rank(df: DataFrame, rank: Column) -> DataFrame:
    return df.orderBy(rank)
