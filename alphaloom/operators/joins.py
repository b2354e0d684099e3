"""Joins of the research panel: as-of, date series, dimensions, membership, turnover pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.calendar import as_of_calendar


def left_join_fill(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi join; columns on both sides become ``coalesce(left, right)``."""
    keys = list(keys)
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(r, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).drop(*[f"_r_{c}" for c in shared])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, first by ``order`` (give a full tie-break).

    ``row_number() <= 1`` lets Spark drop all but one row per key and task before the shuffle.
    """
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn <= 1").drop("_rn")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str = "ts_code",
    left_date: str = "trade_date",
    right_date: str = "ann_date",
    tie: str | None = "end_date",
    left_unique: bool = True,
) -> DataFrame:
    """Keyed backward as-of join: the whole latest right row with ``right_date <= left_date``.

    Right rows sharing (key, date) are reduced to the one with the latest ``tie`` first (NULL
    is the earliest; equal ones are decided by the remaining columns, largest first), so a
    key's group holds at most one row per side and calendar date, however hot the key was in
    the feeds. With ``left_unique=False`` (intraday rows) the match is made on the distinct
    (key, date) pairs and joined back.
    """
    values = [c for c in right.columns if c not in (key,)]
    right = right.where(F.col(key).isNotNull() & F.col(right_date).isNotNull())
    order = F.col(tie) if tie else F.lit(1)
    # a struct's order puts NULL first, so a row without ``tie`` loses to others but is never left out
    ranked = F.max(F.struct(order.alias("o"), F.struct(*values).alias("row")))
    latest = right.groupBy(key, F.col(right_date).alias("_d")).agg(ranked.getField("row").alias("_r")).repartition(key)
    if not left_unique:
        days = left.select(key, left_date).where(F.col(left_date).isNotNull()).distinct()
        return left.join(asof_join(days, right, key, left_date, right_date, tie), [key, left_date], "left")
    clash = [c for c in values if c in left.columns]
    if clash:
        raise ValueError(f"as-of join would duplicate columns: {clash}")
    rest = [c for c in left.columns if c not in (key, left_date)]
    r_type = latest.schema["_r"].dataType
    both = left.select(key, F.col(left_date).alias("_d"), F.lit(1).alias("_side"), *rest, F.lit(None).cast(r_type).alias("_r")).unionByName(
        latest.select(key, "_d", F.lit(0).alias("_side"), "_r"), allowMissingColumns=True
    )
    w = W.partitionBy(key).orderBy("_d", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    matched = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    # key and date stay plain columns: later windows by (key, date) need no further shuffle or sort
    mine = [F.col("_d").alias(left_date) if c == left_date else F.col(c) for c in left.columns]
    return matched.select(*mine, *[F.col(f"_r.{c}").alias(c) for c in values])


def asof_series(panel: DataFrame, series: DataFrame, date: str = "trade_date") -> DataFrame:
    """Unkeyed backward as-of join of a low-frequency series: matched on the calendar, then joined by date.

    The series is first reduced to one whole row per date, the largest by its columns in turn. The matched
    table has one row per calendar date, so it is broadcast and the panel is not shuffled.
    """
    values = [c for c in series.columns if c != date]
    series = series.groupBy(date).agg(F.max(F.struct(*values)).alias("_v")).select(date, "_v.*")
    dates = panel.select(date).where(F.col(date).isNotNull()).select(date).distinct()
    matched = as_of_calendar(dates, series.where(F.col(date).isNotNull()), date).drop("as_of_date")
    return panel.join(F.broadcast(matched), date, "left")


def join_date_series(panel: DataFrame, series: DataFrame, date: str = "trade_date") -> DataFrame:
    """Left join of a series by date; of several rows of a date the whole least one (column by column) counts."""
    values = [c for c in series.columns if c != date]
    unique = series.groupBy(date).agg(F.min(F.struct(*values)).alias("_v")).select(date, "_v.*") if values else series.distinct()
    return panel.join(F.broadcast(unique), date, "left")


def full_outer_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several statements on the same keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def two_channel_total(a: DataFrame, b: DataFrame, key: str, a_value: str, b_value: str, total: str) -> DataFrame:
    """Full outer join of two channels on a date; the total counts a missing channel as 0."""
    joined = a.join(b, key, "full")
    return joined.withColumn(total, F.coalesce(a_value, F.lit(0.0)) + F.coalesce(b_value, F.lit(0.0)))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Dictionary lookup with a default: left join and ``coalesce``."""
    found = df.join(table.select(key, F.col(value).alias("_v")), key, "left")
    return found.withColumn(value, F.coalesce(F.col("_v"), F.lit(default))).drop("_v")


def members_only(panel: DataFrame, membership: DataFrame, date: str = "trade_date", month: str = "month") -> DataFrame:
    """Point-in-time filter: keep (code, date) rows whose (code, month) is in ``membership``.

    ``membership[month]`` is the first day of the month. Apply after all per-code windows.
    """
    keyed = panel.withColumn(month, F.date_trunc("month", F.col(date)).cast("date"))
    return keyed.join(membership.select("ts_code", month), ["ts_code", month], "left_semi").drop(month)


def former_members(history: DataFrame, current: DataFrame, key: str = "ts_code") -> DataFrame:
    """Distinct historical codes that are not in the current table."""
    return history.select(key).distinct().join(current.select(key), key, "left_anti")


def attach_predictions(panel: DataFrame, predictions: DataFrame, columns: Sequence[str], score: str | None = "ml_score") -> DataFrame:
    """Left join of predictions on (date, code); ``score`` also becomes the ``score`` column."""
    out = panel.join(predictions.select("trade_date", "ts_code", *columns), ["trade_date", "ts_code"], "left")
    return out.withColumn("score", F.col(score)) if score else out
