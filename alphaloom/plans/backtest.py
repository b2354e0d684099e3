"""Back-tests of score panels: positions, NAV, metrics. Scenario columns run side by side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators import risk, tilt
from alphaloom.operators.metrics import performance_metrics
from alphaloom.operators.nav import daily_nav, slice_nav
from alphaloom.operators.positions import MIN_WEIGHT, equal_weight_book
from alphaloom.operators.staging import per_date, stage


@dataclass(frozen=True)
class Backtest:
    """NAV, positions and metrics of one or more scenarios."""

    nav: DataFrame
    positions: DataFrame
    metrics: DataFrame
    by: tuple[str, ...] = ()

    def window(self, start: str, end: str | None = None) -> Backtest:
        """Cut to a test window, rebased, with the metrics computed again."""
        nav = slice_nav(self.nav, start, end, self.by)
        pos = self.positions.where(F.col("rebalance_date") >= F.lit(start).cast("date"))
        if end is not None:
            pos = pos.where(F.col("rebalance_date") <= F.lit(end).cast("date"))
        return Backtest(nav, pos, performance_metrics(nav, pos, self.by), self.by)


def from_positions(panel: DataFrame, positions: DataFrame, by: Sequence[str] = (), fee: float = 0.001, slippage: float = 0.001) -> Backtest:
    """NAV and metrics of any position table with weight and turnover."""
    positions = stage(positions)
    nav = stage(daily_nav(panel, positions, by, fee, slippage))
    return Backtest(nav, positions, performance_metrics(nav, positions, by), tuple(by))


def equal_weight(panel: DataFrame, n: int = 20, score: str = "score", by: Sequence[str] = (), period: str = "month") -> Backtest:
    """Top-N equal-weight back-test."""
    return from_positions(panel, equal_weight_book(panel, n, score, period, by), by)


def tilted_positions(
    prepared: DataFrame,
    panel: DataFrame,
    limits: risk.Limits = risk.Limits(),
    by: Sequence[str] = (),
    gamma: float = 0.0,
    max_turnover: dict | None = None,
) -> DataFrame:
    """Constrained tilt, turnover-limited path and the diagnostics of the finished path.

    ``prepared`` comes from ``prepare_snapshot``; risk is estimated on the plain snapshot codes
    of each date, once for all scenarios.
    """
    by, keys = list(by), [*by, "rebalance_date"]
    codes = stage(prepared.select("rebalance_date", "ts_code").distinct())
    windows = risk.return_windows(codes, panel, limits.covariance_window)
    shrink = risk.shrinkage(windows, codes, limits.covariance_window)
    target = stage(tilt.tilt(prepared, windows, shrink, limits, by, gamma=gamma))
    path = tilt.turnover_path(target.select(*keys, "ts_code", "weight"), limits, by, max_turnover)
    status = target.groupBy(*keys).agg(F.min("optimization_status").alias("optimization_status"))
    extra = F.col("extra_variance") if "extra_variance" in prepared.columns else None
    kept = [*keys, "ts_code", "score", "benchmark_weight", "industry_name", *(["extra_variance"] if extra is not None else [])]
    rows = prepared.select(*kept).join(path, [*keys, "ts_code"], "left")
    rows = stage(rows.withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    diag = risk.diagnostics(rows, windows, shrink, by, limits.covariance_ridge, extra)
    diag = diag.select(*keys, F.col("snapshot_turnover").alias("turnover"), "ex_ante_tracking_error", "max_industry_deviation")
    out = rows.where(F.col("weight") > MIN_WEIGHT).join(per_date(diag, by), keys).join(per_date(status, by), keys)
    return out.select(
        *keys, "ts_code", "weight", "score", "benchmark_weight", "industry_name", "turnover", "ex_ante_tracking_error", "max_industry_deviation", "optimization_status"
    )
