"""Training windows split into a proper and a calibration part, without a copy of each row per window.

The rows of a window with the ``ceil(ratio n)`` smallest keys calibrate, the others train. Counts
per day and range of keys, summed per window on the calendar, show in which range the last
calibration key lies; only rows of that range are then looked at to find it. A day's windows
cut its keys into a few intervals, and moments per day and interval add up to each window's
proper part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.moments import moments, window_moments
from alphaloom.operators.order_stats import OrderStat, grouped_order_stats
from alphaloom.operators.staging import stage

RANGES = 256


@dataclass(frozen=True)
class SplitWindows:
    """``rows``: labelled panel rows with ``_key``; ``days``: (window_id, trade_date, cut, below) of the windows with enough rows,
    ``cut`` being the last calibration key and ``below`` the number of smaller cuts on that day; ``cuts``: (trade_date, cuts),
    a day's cuts in order."""

    rows: DataFrame
    days: DataFrame
    cuts: DataFrame
    label: str

    def proper(self, window=None) -> DataFrame:
        """Proper rows with their ``window_id``: of one window, or (a copy of a row for each of its windows) of all."""
        days = self.days if window is None else self.days.where(F.col("window_id") == F.lit(window))
        return self.rows.join(days.select("window_id", "trade_date", "cut"), "trade_date").where("_key > cut").drop("cut")

    def calibration(self) -> DataFrame:
        """Calibration rows, once for each window that they calibrate."""
        return self.rows.join(self.days.select("window_id", "trade_date", "cut"), "trade_date").where("_key <= cut").drop("cut")

    def proper_moments(self, features: list[Column], y: Column) -> DataFrame:
        """Staged moments of each window's proper part, from one pass over the rows."""
        inside = F.size(F.filter("cuts", lambda c: c < F.col("_key")))
        parts = stage(moments(self.rows.join(self.cuts, "trade_date").withColumn("_interval", inside), ["trade_date", "_interval"], features, y))
        return window_moments(parts, self.days, len(features), "_interval > below")

    @cached_property
    def spans(self) -> list:
        """(window_id, its days as numbers, cut) of every window; calendar-sized."""
        rows = self.days.groupBy("window_id", "cut").agg(F.sort_array(F.collect_list(F.unix_date("trade_date"))).alias("days")).orderBy("window_id").collect()
        return [(r["window_id"], r["days"], r["cut"]) for r in rows]


def split_windows(panel: DataFrame, windows: DataFrame, label: str, key: Column, ratio: float = 0.3, min_rows: int = 4) -> SplitWindows:
    """Split the windows that have at least ``min_rows`` labelled rows. ``panel`` is read several times: stage it."""
    rows = panel.where(F.col(label).isNotNull()).withColumn("_key", key.cast("double"))
    low, high = rows.agg(F.min("_key"), F.max("_key")).first()
    width = ((high or 0.0) - (low or 0.0)) / RANGES or 1.0
    number = F.least(F.floor((F.col("_key") - F.lit(low or 0.0)) / F.lit(width)), F.lit(RANGES - 1)).cast("int")
    daily = rows.select("trade_date", number.alias("_range")).groupBy("trade_date", "_range").agg(F.count("_range").alias("n"))
    counts = daily.join(windows, "trade_date").groupBy("window_id", "_range").agg(F.sum("n").alias("n"))
    window = W.partitionBy("window_id")
    upto = F.sum("n").over(window.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.select("window_id", "_range", "n", upto.alias("upto"), F.ceil(F.sum("n").over(window) * F.lit(ratio)).alias("k"), F.sum("n").over(window).alias("all"))
    holds = counts.where((F.col("all") >= min_rows) & (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    holds = stage(holds.select("window_id", "_range", (F.col("k") - F.col("upto") + F.col("n")).alias("_want")))
    edge = rows.select("trade_date", "_key", number.alias("_range")).join(windows.join(holds, "window_id"), ["trade_date", "_range"])
    edge = stage(edge.select("window_id", "_key", "_want"))
    cut = grouped_order_stats(edge, ["window_id"], {"cut": OrderStat(F.col("_key"), rank_column="_want")}).select("window_id", "cut")
    days = stage(windows.join(cut, "window_id").select("window_id", "trade_date", "cut"))
    cuts = stage(days.groupBy("trade_date").agg(F.sort_array(F.collect_set("cut")).alias("cuts")))
    days = stage(days.join(cuts, "trade_date").select("window_id", "trade_date", "cut", (F.array_position("cuts", F.col("cut")) - 1).alias("below")))
    return SplitWindows(rows, days, cuts, label)
