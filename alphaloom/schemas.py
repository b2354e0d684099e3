"""Declared schemas of the tables the library reads and writes, and the column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(strings: str = "", dates: str = "", doubles: str = "", stamps: str = "") -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings.split()]
    fields += [T.StructField(n, T.DateType()) for n in dates.split()]
    fields += [T.StructField(n, T.TimestampNTZType()) for n in stamps.split()]
    fields += [T.StructField(n, T.DoubleType()) for n in doubles.split()]
    return T.StructType(fields)


# Fixed table layouts.
CONSTITUENTS = _schema("bs_code code_6 stock_name exchange", doubles="weight_pct")
INDEX_WEIGHT = _schema("index_code con_code", "trade_date", "weight")
DAILY = _schema(
    "ts_code", "trade_date", "open high low close pre_close vol amount turnover_rate"
)
DAILY_BASIC = _schema(
    "ts_code",
    "trade_date",
    "turnover_rate turnover_rate_f volume_ratio pe_ttm pb total_mv float_mv ps_ttm dv_ttm",
)
FINANCIALS = _schema(
    "ts_code",
    "ann_date end_date",
    "roe grossprofit_margin netprofit_margin yoy_net_profit asset_turnover cfo_to_or equity_multiplier",
)
BENCHMARK = _schema("ts_code", "trade_date", "open high low close pre_close vol amount")
MINUTE = _schema("ts_code", stamps="trade_datetime", doubles="open high low close vol amount")
PREDICTIONS = _schema("ts_code", "trade_date", "label_excess_return_20d ml_score")
CONFORMAL = _schema(
    "ts_code",
    "trade_date",
    "label_excess_return_20d ml_score ci_lower ci_upper ci_half_width confidence",
)
IMPORTANCE = _schema("feature", "trade_date", "importance")
POSITIONS = _schema(
    "ts_code industry_name optimization_status",
    "rebalance_date",
    "weight score benchmark_weight turnover ex_ante_tracking_error max_industry_deviation",
)
NAV = _schema(
    "",
    "trade_date",
    "portfolio_return gross_portfolio_return benchmark_return excess_return transaction_cost "
    "portfolio_nav benchmark_nav excess_nav",
)

TABLES = {
    "constituents": CONSTITUENTS,
    "index_weight": INDEX_WEIGHT,
    "daily": DAILY,
    "daily_basic": DAILY_BASIC,
    "financials": FINANCIALS,
    "benchmark": BENCHMARK,
    "minute": MINUTE,
    "predictions": PREDICTIONS,
    "conformal_predictions": CONFORMAL,
    "importance": IMPORTANCE,
    "positions": POSITIONS,
    "nav": NAV,
}


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming every missing column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
    return df


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """Typed empty table."""
    return spark.createDataFrame([], TABLES[name])
