"""Daily NAV of position tables, with costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import safe_ratio
from alphaloom.operators.calendar import expand_index_ranges, trading_calendar
from alphaloom.operators.staging import per_date
from alphaloom.schemas import require_columns


def holding_days(positions: DataFrame, calendar: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(scenario, rebalance_date, trade_date): the days each book is effective.

    A book counts from the day after its rebalance up to and including the next rebalance day.
    """
    by = list(by)
    marks = positions.select(*by, "rebalance_date").distinct()
    marks = marks.join(F.broadcast(calendar.withColumnRenamed("trade_date", "rebalance_date")), "rebalance_date")
    last = calendar.agg(F.max("idx")).scalar()
    nxt = F.coalesce(F.lead("idx").over(W.partitionBy(*by).orderBy("rebalance_date")), last)
    marks = marks.withColumn("_next", nxt).withColumnRenamed("idx", "_own")
    return expand_index_ranges(marks, calendar, F.col("_own") + 1, F.col("_next")).select(*by, "rebalance_date", "trade_date")


def gross_returns(panel: DataFrame, positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``Σ w·r`` per scenario and day. Books are spread over their days, then meet the returns
    on (code, day); a missing return counts as 0."""
    by = list(by)
    days = holding_days(positions, trading_calendar(panel), by)
    held = positions.select(*by, "rebalance_date", "ts_code", "weight").join(per_date(days, by), [*by, "rebalance_date"])
    moves = panel.select("ts_code", "trade_date", "daily_return").where("daily_return IS NOT NULL")
    return (
        held.join(moves, ["ts_code", "trade_date"])
        .groupBy(*by, "trade_date")
        .agg(F.sum(F.col("weight") * F.col("daily_return")).alias("gross_portfolio_return"))
    )


def benchmark_by_day(panel: DataFrame) -> DataFrame:
    """Benchmark return of each day: the row of the smallest code, NULL as 0."""
    require_columns(panel, ["benchmark_daily_return"], "panel")
    return panel.groupBy("trade_date").agg(
        F.coalesce(F.min_by("benchmark_daily_return", "ts_code"), F.lit(0.0)).alias("benchmark_return")
    )


def daily_nav(panel: DataFrame, positions: DataFrame, by: Sequence[str] = (), fee: float = 0.001, slippage: float = 0.001) -> DataFrame:
    """NAV table per scenario over all panel dates.

    On a rebalance day the NAV also pays ``2·turnover·(fee + slippage)``. All windows here
    run over one row per day and scenario.
    """
    by = list(by)
    bench = benchmark_by_day(panel)
    cost = positions.groupBy(*by, "rebalance_date").agg((F.max("turnover") * 2.0 * (fee + slippage)).alias("transaction_cost"))
    cost = cost.withColumnRenamed("rebalance_date", "trade_date")
    grid = bench
    if by:
        calendar = bench.agg(F.sort_array(F.collect_set("trade_date"))).scalar()
        grid = positions.select(*by).distinct().withColumn("trade_date", F.explode(calendar)).join(F.broadcast(bench), "trade_date")
    days = grid.join(gross_returns(panel, positions, by), [*by, "trade_date"], "left").join(cost, [*by, "trade_date"], "left")
    days = days.withColumns(
        {
            "gross_portfolio_return": F.coalesce("gross_portfolio_return", F.lit(0.0)),
            "transaction_cost": F.coalesce("transaction_cost", F.lit(0.0)),
        }
    )
    w = W.partitionBy(*by).orderBy("trade_date")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    growth = (1.0 + F.col("gross_portfolio_return")) * F.greatest(1.0 - F.col("transaction_cost"), F.lit(0.0))
    days = days.withColumn("portfolio_nav", F.product(growth).over(run))
    days = days.withColumn("benchmark_nav", F.product(1.0 + F.col("benchmark_return")).over(run))
    start = F.lag("portfolio_nav", 1, 1.0).over(w)
    days = days.withColumn("portfolio_return", F.when(start != 0, F.col("portfolio_nav") / start - 1.0).otherwise(0.0))
    return days.select(
        *by,
        "trade_date",
        "portfolio_return",
        "gross_portfolio_return",
        "benchmark_return",
        (F.col("portfolio_return") - F.col("benchmark_return")).alias("excess_return"),
        "transaction_cost",
        "portfolio_nav",
        "benchmark_nav",
        safe_ratio(F.col("portfolio_nav"), F.col("benchmark_nav")).alias("excess_nav"),
    )


def slice_nav(nav: DataFrame, start: str, end: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cut a NAV table to [start, end] and rebase both NAVs to 1 on its first row."""
    cut = nav.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        cut = cut.where(F.col("trade_date") <= F.lit(end).cast("date"))
    w = W.partitionBy(*by).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    first = {c: F.col(c) / F.first(c).over(w) for c in ("portfolio_nav", "benchmark_nav")}
    return cut.withColumns(first).withColumn("excess_nav", safe_ratio(F.col("portfolio_nav"), F.col("benchmark_nav")))


def drawdowns(nav: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drawdown series of portfolio and benchmark."""
    w = W.partitionBy(*by).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return nav.select(
        *by,
        "trade_date",
        (F.col("portfolio_nav") / F.max("portfolio_nav").over(w) - 1.0).alias("drawdown"),
        (F.col("benchmark_nav") / F.max("benchmark_nav").over(w) - 1.0).alias("benchmark_drawdown"),
    )
