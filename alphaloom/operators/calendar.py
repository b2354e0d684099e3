"""Trading calendar operators.

Every table here has at most one row per calendar date (times a fixed list of scenarios):
a century of dates is under 40,000 rows. That bound is what allows the single-partition
windows below and the broadcast of calendar tables elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trading_calendar(panel: DataFrame, date: str = "trade_date") -> DataFrame:
    """Distinct dates in order with their ordinal ``idx`` (from 1)."""
    dates = panel.select(date).where(F.col(date).isNotNull()).select(date).distinct()
    return dates.withColumn("idx", F.row_number().over(W.orderBy(date)))


def period_ends(panel: DataFrame, period: str = "month", date: str = "trade_date", by: Sequence[str] = ()) -> DataFrame:
    """Last date present in each calendar period: the rebalance dates."""
    bucket = F.date_trunc(period, F.col(date)).cast("date")
    return (
        panel.where(F.col(date).isNotNull())
        .groupBy(*by, bucket.alias("period"))
        .agg(F.max(date).alias(date))
    )


def shift_dates(calendar: DataFrame, n: int, name: str, date: str = "trade_date") -> DataFrame:
    """Each date with the date ``n`` trading rows later (NULL past the end; n may be negative)."""
    order = W.orderBy("idx")
    return calendar.select(date, "idx", F.lead(date, n).over(order).alias(name))


def expand_index_ranges(ranges: DataFrame, calendar: DataFrame, first: Column, last: Column, date: str = "trade_date") -> DataFrame:
    """Range join on the calendar as an equi join: one row per (range, date) with ``first <= idx <= last``.

    The range is unrolled to its ordinals, so no pair of a range and a date outside it is formed.
    """
    spans = ranges.withColumn("_first", F.greatest(first, F.lit(1))).withColumn("_last", last)
    spans = spans.where("_first <= _last").withColumn("idx", F.explode(F.sequence("_first", "_last")))
    return spans.drop("_first", "_last").join(F.broadcast(calendar.select(date, "idx")), "idx").drop("idx")


def as_of_calendar(
    left: DataFrame,
    right: DataFrame,
    date: str = "trade_date",
    by: Sequence[str] = (),
    strict: bool = False,
    right_date: str = "as_of_date",
) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left date; calendar-sized inputs only."""
    values = [c for c in right.columns if c not in (date, *by)]
    packed = F.struct(F.col(date).alias(right_date), *values)
    side_right, side_left = (1, 0) if strict else (0, 1)
    merged = left.select(*by, date, F.lit(side_left).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_r"))
    merged = merged.unionByName(
        right.select(*by, date, F.lit(side_right).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("p")).schema["p"].dataType).alias("_l"), packed.alias("_r"))
    )
    order = W.partitionBy(*by).orderBy(date, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = merged.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_l IS NOT NULL")
    return merged.select("_l.*", F.col(f"_r.{right_date}").alias(right_date), *[F.col(f"_r.{c}").alias(c) for c in values])


def month_spine(first: Column, last: Column, name: str = "month") -> Column:
    """Column expanding to every month start between two dates."""
    return F.explode(F.sequence(F.date_trunc("month", first).cast("date"), F.date_trunc("month", last).cast("date"), F.expr("interval 1 month"))).alias(name)
