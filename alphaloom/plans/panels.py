"""From conformed feeds to the research panel and the factor panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators.cross_section import model_panel
from alphaloom.operators.factors import FactorWindows, compute_factors, excess_return_label, resolve_features
from alphaloom.operators.joins import asof_join, asof_series, join_date_series, left_join_fill, members_only
from alphaloom.operators.membership import UNKNOWN, benchmark_profile, float_cap_weights
from alphaloom.operators.staging import stage
from alphaloom.sources.conform import panel_financials


@dataclass(frozen=True)
class Feeds:
    """Conformed tables; only ``bars`` is required."""

    bars: DataFrame
    valuation: DataFrame | None = None
    financials: DataFrame | None = None
    industry: DataFrame | None = None
    universe: DataFrame | None = None
    benchmark: DataFrame | None = None
    flow: DataFrame | None = None
    macro: Sequence[DataFrame] = ()


def research_panel(feeds: Feeds) -> DataFrame:
    """Bars with valuation, as-of financials, industry, benchmark weight, flow and as-of macro series."""
    panel = feeds.bars
    if feeds.valuation is not None:
        panel = left_join_fill(panel, feeds.valuation, ["ts_code", "trade_date"])
    if feeds.financials is not None:
        panel = asof_join(panel, panel_financials(feeds.financials))
    if feeds.industry is not None:
        panel = panel.join(feeds.industry.select("ts_code", "industry_name"), "ts_code", "left")
    if feeds.universe is not None:
        panel = panel.join(benchmark_profile(feeds.universe, feeds.bars), "ts_code", "left")
    if feeds.flow is not None:
        panel = join_date_series(panel, feeds.flow).withColumn("northbound_net_inflow", F.col("north_money"))
    for series in feeds.macro:
        panel = asof_series(panel, series)
    return panel


def factor_panel(feeds: Feeds, horizon: int = 20, windows: FactorWindows = FactorWindows(), by_industry: bool = True) -> DataFrame:
    """Research panel with factors and label, standardised per cross-section."""
    labelled = stage(excess_return_label(compute_factors(research_panel(feeds), windows), feeds.benchmark, horizon))
    return model_panel(labelled, resolve_features(available=labelled.columns), by_industry)


def point_in_time_panel(feeds: Feeds, membership: DataFrame, horizon: int = 20) -> DataFrame:
    """As :func:`factor_panel`, cut to the members of each month after all per-security windows, with
    float-cap benchmark weights."""
    labelled = excess_return_label(compute_factors(research_panel(feeds)), feeds.benchmark, horizon)
    if "industry_name" in labelled.columns:
        labelled = labelled.withColumn("industry_name", F.coalesce("industry_name", F.lit(UNKNOWN)))
    members = stage(members_only(labelled, membership))
    weighted = stage(float_cap_weights(members.drop("benchmark_weight")))
    return model_panel(weighted, resolve_features(available=weighted.columns))
