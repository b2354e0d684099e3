"""The seventeen performance metrics, one row per scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import compound, near_zero, safe_ratio

DAYS_PER_YEAR = 252.0

# Fixed metric order.
METRICS = (
    "annual_return",
    "benchmark_annual_return",
    "annual_excess_return",
    "annual_volatility",
    "sharpe_ratio",
    "tracking_error",
    "information_ratio",
    "max_drawdown",
    "benchmark_max_drawdown",
    "excess_max_drawdown",
    "monthly_win_rate",
    "upside_capture",
    "downside_capture",
    "annual_turnover",
    "avg_ex_ante_tracking_error",
    "max_ex_ante_tracking_error",
    "avg_max_industry_deviation",
)


def _annualised(nav: str) -> Column:
    """Annual growth from first to last non-null NAV; the exponent uses the number of rows."""
    present = F.col(nav).isNotNull()
    day = F.when(present, F.col("trade_date"))
    rows = F.count(nav)
    growth = F.max_by(nav, day) / F.min_by(nav, day)
    return F.when(rows >= 2, F.pow(growth, F.lit(DAYS_PER_YEAR) / rows) - 1.0)


def monthly_win_rate(nav: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of months whose compounded portfolio return beats the benchmark's."""
    months = nav.groupBy(*by, F.date_trunc("month", F.col("trade_date")).alias("month")).agg(
        compound(F.col("portfolio_return")).alias("p"), compound(F.col("benchmark_return")).alias("b")
    )
    win = F.avg(F.coalesce(F.col("p") > F.col("b"), F.lit(False)).cast("int"))
    return months.groupBy(*by).agg(win.alias("monthly_win_rate"))


def capture(up: bool) -> Column:
    """Compounded portfolio over compounded benchmark return on the benchmark's up (down) days."""
    b = F.coalesce("benchmark_return", F.lit(0.0))
    side = b > 0 if up else b < 0
    total_b = F.product(F.when(side, 1.0 + b)) - 1.0
    total_p = F.product(F.when(side, 1.0 + F.coalesce("portfolio_return", F.lit(0.0)))) - 1.0
    return F.when(~near_zero(total_b), total_p / total_b)


def _position_metrics(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    per_date = positions.groupBy(*by, "rebalance_date").agg(
        F.max("turnover").alias("turnover"),
        F.max("ex_ante_tracking_error").alias("te"),
        F.max("max_industry_deviation").alias("dev"),
    )
    return per_date.groupBy(*by).agg(
        (F.avg(F.coalesce("turnover", F.lit(0.0))) * 12.0).alias("annual_turnover"),
        F.avg("te").alias("avg_ex_ante_tracking_error"),
        F.max("te").alias("max_ex_ante_tracking_error"),
        F.avg("dev").alias("avg_max_industry_deviation"),
    )


def performance_metrics(nav: DataFrame, positions: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All seventeen metrics keyed by the scenario columns."""
    keys = list(by) or ["_all"]
    if not by:
        nav = nav.withColumn("_all", F.lit(1))
        positions = positions.withColumn("_all", F.lit(1)) if positions is not None else None
    w = W.partitionBy(*keys).orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    falls = {f"_dd_{c}": F.col(c) / F.max(c).over(w) - 1.0 for c in ("portfolio_nav", "benchmark_nav", "excess_nav")}
    p = F.coalesce("portfolio_return", F.lit(0.0))
    b = F.coalesce("benchmark_return", F.lit(0.0))
    year = F.sqrt(F.lit(DAYS_PER_YEAR))
    out = (
        nav.withColumns(falls)
        .groupBy(*keys)
        .agg(
            _annualised("portfolio_nav").alias("annual_return"),
            _annualised("benchmark_nav").alias("benchmark_annual_return"),
            (F.stddev_pop(p) * year).alias("annual_volatility"),
            (F.stddev_pop(p - b) * year).alias("tracking_error"),
            F.min("_dd_portfolio_nav").alias("max_drawdown"),
            F.min("_dd_benchmark_nav").alias("benchmark_max_drawdown"),
            F.min("_dd_excess_nav").alias("excess_max_drawdown"),
            capture(True).alias("upside_capture"),
            capture(False).alias("downside_capture"),
        )
        .withColumn("annual_excess_return", F.col("annual_return") - F.col("benchmark_annual_return"))
        .withColumn("sharpe_ratio", safe_ratio(F.col("annual_return"), F.col("annual_volatility")))
        .withColumn("information_ratio", safe_ratio(F.col("annual_excess_return"), F.col("tracking_error")))
        .join(monthly_win_rate(nav, keys), keys)
    )
    if positions is not None:
        out = out.join(_position_metrics(positions, keys), keys, "left")
    else:
        out = out.withColumns({m: F.lit(None).cast("double") for m in METRICS[13:]})
    return out.select(*by, *METRICS)
