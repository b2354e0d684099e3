"""Cross-sectional cleaning and scoring.

Group statistics are aggregated with map-side combining and joined back, instead of window
functions over a date: a single date may hold any share of the rows. Medians come from
:mod:`alphaloom.operators.order_stats`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.columns import clip, row_mean
from alphaloom.operators.order_stats import grouped_order_stats, median
from alphaloom.operators.staging import stage


def group_transform(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], calendar_keyed: bool = False) -> DataFrame:
    """Attach group aggregates to the rows; rows with a NULL key get NULLs.

    Unless the keys bound its size, the aggregate is staged, so that the join is broadcast or
    shuffled by its true size.
    """
    keys = list(keys)
    stats = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(F.broadcast(stats) if calendar_keyed else stage(stats), keys, "left")


def group_median(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], calendar_keyed: bool = False) -> DataFrame:
    """Add exact group medians, named by the mapping's keys."""
    keys = list(keys)
    med = grouped_order_stats(df, keys, {n: median(c) for n, c in columns.items()})
    med = med.select(*keys, *columns)
    return df.join(F.broadcast(med) if calendar_keyed else med, keys, "left")


def fill_median(df: DataFrame, keys: Sequence[str], column: str, calendar_keyed: bool = False) -> DataFrame:
    """Replace NULLs by the group median."""
    out = group_median(df, keys, {"_med": F.col(column)}, calendar_keyed)
    return out.withColumn(column, F.coalesce(F.col(column), F.col("_med"))).drop("_med")


def winsorize_mad(df: DataFrame, columns: Sequence[str], date: str = "trade_date", n_mad: float = 3.0, strict_nulls: bool = True) -> DataFrame:
    """Clip each column per date to ``median ± n_mad·MAD``.

    With ``strict_nulls`` a (date, column) group holding any NULL is left as it is, which is
    the reference behaviour; otherwise NULLs are skipped. ``df`` is read several times: stage it.
    """
    span = range(len(columns))
    bounds = _mad(df, columns, date)
    limits = []
    for i in span:
        usable = (F.col(f"_n{i}") == F.col("_rows")) if strict_nulls else F.lit(True)
        limits.append(F.when(usable, F.col(f"_m{i}") - n_mad * F.col(f"_a{i}")).alias(f"_lo{i}"))
        limits.append(F.when(usable, F.col(f"_m{i}") + n_mad * F.col(f"_a{i}")).alias(f"_hi{i}"))
    out = df.join(stage(bounds.select(date, *limits)), date, "left")
    out = out.withColumns({c: clip(F.col(c), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, c in enumerate(columns)})
    return out.drop(*[f"_lo{i}" for i in span], *[f"_hi{i}" for i in span])


def _mad(df: DataFrame, columns: Sequence[str], date: str) -> DataFrame:
    """Median, MAD and counts per date, by exact selection; the tables of one row a date are staged."""
    span = range(len(columns))
    rows = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("_rows"))
    med = grouped_order_stats(df, [date], {f"_m{i}": median(F.col(c)) for i, c in enumerate(columns)})
    med = stage(med.select(date, *[f"_m{i}" for i in span]).join(rows, date))
    centred = df.select(date, *columns).join(med, date)
    mad = grouped_order_stats(centred, [date], {f"_a{i}": median(F.abs(F.col(c) - F.col(f"_m{i}"))) for i, c in enumerate(columns)})
    return med.join(mad.select(date, *[f"_a{i}" for i in span], *[F.col(f"_a{i}_n").alias(f"_n{i}") for i in span]), date)


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("trade_date",), ddof: int = 1, flat: float | None = None) -> DataFrame:
    """Group z-scores in place. Zero spread gives ``flat``; a NULL group key gives NULL."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = {f"_m{i}": F.avg(c) for i, c in enumerate(columns)} | {f"_s{i}": std(c) for i, c in enumerate(columns)}
    out = group_transform(df, keys, aggs, calendar_keyed=list(keys) == ["trade_date"])
    z = {}
    for i, c in enumerate(columns):
        value = (F.col(c) - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0))
        z[c] = value if flat is None else F.when(F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) == 0, F.lit(flat)).otherwise(value)
    return out.withColumns(z).drop(*aggs)


def model_panel(df: DataFrame, columns: Sequence[str], by_industry: bool = True, strict_nulls: bool = True) -> DataFrame:
    """Winsorize per date, then z-score per date (and industry when that column exists)."""
    keys = ["trade_date"] + (["industry_name"] if by_industry and "industry_name" in df.columns else [])
    return zscore(winsorize_mad(df, columns, strict_nulls=strict_nulls), columns, keys)


def composite_score(columns: Sequence[str]) -> Column:
    """Null-skipping mean of factor columns, with ``volatility_20`` negated."""
    return row_mean([-F.col(c) if c == "volatility_20" else F.col(c) for c in columns])


def equal_weight_score(df: DataFrame, columns: Sequence[str], test_start: str | None = None) -> DataFrame:
    """Per-date z-scores averaged to ``score``; NULL before ``test_start``. Inputs are kept."""
    zs = [f"_z_{c}" for c in columns]
    out = zscore(df.withColumns({z: F.col(c) for z, c in zip(zs, columns)}), zs)
    score = row_mean([-F.col(z) if c == "volatility_20" else F.col(z) for z, c in zip(zs, columns)])
    if test_start is not None:
        score = F.when(F.col("trade_date") >= F.lit(test_start).cast("date"), score)
    return out.withColumn("score", score).drop(*zs)


def min_max_unit(df: DataFrame, column: str, out: str, keys: Sequence[str] = ("trade_date",), eps: float = 1e-6) -> DataFrame:
    """Scale to [0, 1] per group as ``(x-lo)/(hi-lo+eps)``; a flat group gives 1."""
    calendar_keyed = list(keys) == ["trade_date"]
    df = group_transform(df, keys, {"_lo": F.min(column), "_hi": F.max(column)}, calendar_keyed)
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span <= eps, F.lit(1.0)).otherwise((F.col(column) - F.col("_lo")) / (span + eps))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), value)).drop("_lo", "_hi")
