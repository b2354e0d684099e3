"""Index membership, benchmark weights, industry map and panel enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import positive_finite, to_double
from alphaloom.operators.cross_section import fill_median, group_transform
from alphaloom.operators.joins import asof_series, join_date_series

UNKNOWN = "UNKNOWN"


def benchmark_profile(universe: DataFrame, codes: DataFrame, as_of: str | None = None, date: str = "trade_date") -> DataFrame:
    """Benchmark weight per code from a membership table (con_code, weight), of one date.

    A table with a ``date`` column gives the weights of its latest date on or before ``as_of``,
    or of its earliest date without that; of several rows of a code the largest weight counts.
    Weights are scaled to sum 1; single missing weights stay NULL. Without a weight column,
    or with no weight at all, every code gets 1/n.
    """
    if date in universe.columns:
        day = F.max(F.when(F.col(date) <= F.lit(as_of).cast("date"), F.col(date))) if as_of else F.min(date)
        universe = universe.where(F.col(date) == universe.agg(day.alias("d")).scalar())
    if "weight" not in universe.columns:
        rows = codes.select("ts_code").distinct().withColumn("benchmark_weight", F.lit(None).cast("double"))
    else:
        rows = (
            universe.where("con_code IS NOT NULL")
            .groupBy(F.col("con_code").alias("ts_code"))
            .agg(F.max(to_double(F.col("weight"))).alias("benchmark_weight"))
            .join(codes.select("ts_code").distinct(), "ts_code", "left_semi")
        )
    total = rows.agg(F.sum("benchmark_weight").alias("s"), F.count(F.lit(1)).alias("n"))
    s, n = total.select("s").scalar(), total.select("n").scalar()
    weight = F.when(s.isNull(), F.lit(1.0) / n).when(s > 0, F.col("benchmark_weight") / s).otherwise(F.col("benchmark_weight"))
    return rows.withColumn("benchmark_weight", weight)


def float_cap_weights(panel: DataFrame) -> DataFrame:
    """Benchmark weight from the float-cap proxy ``close·vol/turnover``.

    A proxy that is not positive and finite takes the day's median; a day without any proxy is
    weighted equally. Weights sum to 1 per day.
    """
    turn = F.when(F.col("turnover_rate") > 0, F.col("turnover_rate"))
    proxy = positive_finite(F.try_divide(F.col("close") * F.col("vol"), turn))
    rows = fill_median(panel.withColumn("_proxy", proxy), ["trade_date"], "_proxy", calendar_keyed=True)
    rows = rows.withColumn("_proxy", F.coalesce("_proxy", F.lit(1.0)))
    rows = group_transform(rows, ["trade_date"], {"_sum": F.sum("_proxy")}, calendar_keyed=True)
    return rows.withColumn("benchmark_weight", F.col("_proxy") / F.col("_sum")).drop("_proxy", "_sum")


def patch_industry(panel: DataFrame, full_map: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Industry from a full-market map, else the panel's own, else ``unknown``."""
    mapped = full_map.where("industry_name IS NOT NULL").groupBy("ts_code").agg(F.min("industry_name").alias("_map"))
    own = F.col("industry_name") if "industry_name" in panel.columns else F.lit(None).cast("string")
    return panel.join(mapped, "ts_code", "left").withColumn("industry_name", F.coalesce("_map", own, F.lit(unknown))).drop("_map")


def unknown_share(panel: DataFrame, full_map: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Share of rows without an industry before and after the patch."""
    before = panel.withColumn("_was", F.coalesce("industry_name", F.lit(unknown)) == unknown)
    return patch_industry(before, full_map, unknown).agg(
        F.avg(F.col("_was").cast("int")).alias("before"), F.avg((F.col("industry_name") == unknown).cast("int")).alias("after")
    )


def carry_membership(snapshots: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Monthly membership with empty months taking the last known set.

    Only months are carried on the spine; the sets follow by one join on the source month.
    """
    have = snapshots.select("month").distinct()
    lo = F.lit(first).cast("date") if first else have.agg(F.min("month")).scalar()
    hi = F.lit(last).cast("date") if last else have.agg(F.max("month")).scalar()
    spine = snapshots.sparkSession.range(1).select(F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("month"))
    marked = spine.join(have.withColumn("_src", F.col("month")), "month", "left")
    run = W.orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    source = marked.select("month", F.last("_src", ignorenulls=True).over(run).alias("_src")).where("_src IS NOT NULL")
    members = snapshots.select(F.col("month").alias("_src"), "ts_code").distinct()
    return members.join(F.broadcast(source), "_src").select("month", "ts_code")


def membership_union(snapshots: DataFrame) -> DataFrame:
    """Every code that was ever a member."""
    return snapshots.select("ts_code").distinct()


def membership_span(membership: DataFrame) -> DataFrame:
    """First and last month of each code."""
    return membership.groupBy("ts_code").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def enrich_panel(panel: DataFrame, daily: Sequence[DataFrame] = (), low_frequency: Sequence[DataFrame] = ()) -> DataFrame:
    """Add external series the panel does not have yet: daily ones by date, low-frequency ones as of the date."""
    for series, attach in [(s, join_date_series) for s in daily] + [(s, asof_series) for s in low_frequency]:
        new = [c for c in series.columns if c != "trade_date" and c not in panel.columns]
        if new:
            panel = attach(panel, series.select("trade_date", *new))
    return panel
