"""Risk of active positions without a p x p matrix.

The covariance is the shrunk estimator ``(1-s)·S + s·mu·I + ridge·I`` of the last ``window``
return days before a rebalance, missing returns counting as 0. Only two things are ever
needed from it: the scalars ``s`` and ``mu``, which come from the T x T Gram matrix
(T <= window), and ``a'Sa``, which is the population variance over days of ``Σ_i a_i x_ti``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.staging import per_date, stage

YEAR = 252.0
UNLIMITED = 10.0
SALTS = 16


@dataclass(frozen=True)
class Limits:
    """Constraint and objective settings of one scenario."""

    max_tracking_error: float = 0.08
    max_industry_deviation: float = 0.02
    max_weight: float = 0.05
    max_turnover: float = 0.20
    risk_aversion: float = 5.0
    turnover_penalty: float = 0.002
    covariance_window: int = 60
    covariance_ridge: float = 1e-4


def _histories(snapshot: DataFrame, panel: DataFrame, window: int) -> DataFrame:
    """(rebalance_date, ts_code, _h): the last ``window`` returns (d, x) before the rebalance of each snapshot row in the panel."""
    entry = F.struct(F.col("trade_date").alias("d"), F.col("daily_return").alias("x"))
    history = panel.where("trade_date IS NOT NULL").groupBy("ts_code").agg(F.array_sort(F.collect_list(entry)).alias("_h"))
    codes = snapshot.select("rebalance_date", "ts_code").distinct()
    date = F.col("rebalance_date")
    each = codes.join(history, "ts_code").where(F.exists("_h", lambda e: e["d"] == date))
    own = F.filter("_h", lambda e: (e["d"] < date) & e["x"].isNotNull())
    each = each.select("rebalance_date", "ts_code", own.alias("_h")).where(F.size("_h") > 0)
    return each.select("rebalance_date", "ts_code", F.slice("_h", F.greatest(F.size("_h") - (window - 1), F.lit(1)), F.lit(window)).alias("_h"))


def return_windows(snapshot: DataFrame, panel: DataFrame, window: int = 60) -> DataFrame:
    """(rebalance_date, ts_code, trade_date, x, t, n_days): returns of the snapshot's codes on the
    last ``window`` days before the rebalance on which any of them has a return.

    A wanted day is always among some code's own last ``window`` returns. A code's history is one
    array, no longer than the calendar; a snapshot row takes its last ``window`` returns from it and
    is shuffled as one row, and only the returns on wanted days become rows.
    """
    each = stage(_histories(snapshot, panel, window))
    days = each.select("rebalance_date", F.explode("_h.d").alias("trade_date")).distinct()
    latest = W.partitionBy("rebalance_date").orderBy(F.col("trade_date").desc())
    days = days.withColumn("t", F.row_number().over(latest)).where(F.col("t") <= window)
    days = stage(days.withColumn("n_days", F.count(F.lit(1)).over(W.partitionBy("rebalance_date"))))
    rows = each.select("rebalance_date", "ts_code", F.inline("_h")).withColumnRenamed("d", "trade_date")
    out = rows.join(F.broadcast(days), ["rebalance_date", "trade_date"])
    return stage(out.select("rebalance_date", "trade_date", "ts_code", "x", "t", "n_days"))


def aligned_windows(windows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(rebalance_date, ts_code, trade_date, x): every snapshot code on every day of its rebalance's
    window, a missing return counted as 0; at most the window's length a snapshot row."""
    days = windows.groupBy("rebalance_date").agg(F.collect_set("trade_date").alias("_days"))
    grid = snapshot.select("rebalance_date", "ts_code").distinct().join(stage(days), "rebalance_date")
    grid = grid.select("rebalance_date", "ts_code", F.explode("_days").alias("trade_date"))
    rows = grid.join(windows.select("rebalance_date", "ts_code", "trade_date", "x"), ["rebalance_date", "ts_code", "trade_date"], "left")
    return rows.withColumn("x", F.coalesce("x", F.lit(0.0)))


def _gram(window: int):
    def gram(group: pa.Table) -> pa.Table:
        """Upper triangle of the Gram matrix (day by day) of one salt's centred series; days without a return are zeros."""
        t, r = group["t"].combine_chunks(), group["r"].combine_chunks()
        at = np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy())), t.flatten().to_numpy() - 1
        x, taken = np.zeros((len(t), window)), np.zeros((len(t), window), bool)
        x[at], taken[at] = r.flatten().fill_null(0.0).to_numpy(), True
        if taken.sum() < len(at[0]):
            raise ValueError("a code has several returns on one day")
        days = group["n_days"][0].as_py()
        # a window shorter than ``window`` days is filled up with zeros, which add nothing
        x[:, :days] -= x.sum(axis=1, keepdims=True) / days
        upper = (x.T @ x)[np.triu_indices(window)]
        return pa.table({"rebalance_date": group["rebalance_date"][:1], "g": pa.array([upper], pa.list_(pa.float64()))})

    return gram


def _gram_sums(width: int):
    def sums(group: pd.DataFrame) -> pd.DataFrame:
        """Sum of squares, trace and sum of squared diagonal of the added-up matrix of one rebalance."""
        upper = np.stack(group["g"].to_numpy()).sum(axis=0)
        i, j = np.triu_indices(width)
        diagonal = upper[i == j]
        row = {"rebalance_date": group["rebalance_date"].iloc[0], "_sq": 2 * (upper**2).sum() - (diagonal**2).sum(), "_tr": diagonal.sum(), "_d4": (diagonal**2).sum()}
        return pd.DataFrame([row])

    return sums


def shrinkage(windows: DataFrame, snapshot: DataFrame, window: int = 60) -> DataFrame:
    """(rebalance_date, n_days, p, mu, shrink): target scale and intensity of the shrunk covariance.

    Codes are dealt to ``SALTS`` groups a rebalance; each group adds up its codes' centred outer
    products to one triangle of at most ``window (window + 1) / 2`` numbers, so ``SALTS`` rows a
    rebalance are left to be added, whatever the number of codes and tasks. Codes without any return count in ``p`` with zeros.
    """
    salted = windows.withColumn("_salt", F.pmod(F.xxhash64("ts_code"), F.lit(SALTS))).repartition("rebalance_date", "_salt")
    series = salted.groupBy("rebalance_date", "_salt", "ts_code", "n_days").agg(F.collect_list(F.struct("t", F.coalesce("x", F.lit(0.0)).alias("x"))).alias("_m"))
    series = series.select("rebalance_date", "_salt", "n_days", F.col("_m.t").alias("t"), F.col("_m.x").alias("r"))
    parts = series.groupBy("rebalance_date", "_salt").applyInArrow(_gram(window), "rebalance_date date, g array<double>")
    sums = parts.groupBy("rebalance_date").applyInPandas(_gram_sums(window), "rebalance_date date, _sq double, _tr double, _d4 double")
    size = snapshot.select("rebalance_date", "ts_code").distinct().groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("p"))
    t = windows.groupBy("rebalance_date").agg(F.max("n_days").alias("n_days"))
    out = size.join(t, "rebalance_date", "left").join(sums, "rebalance_date", "left")
    n, p = F.col("n_days").cast("double"), F.col("p").cast("double")
    mu = F.col("_tr") / (n * p)
    norm = F.col("_sq") / (n * n)
    delta = (norm - p * mu * mu) / p
    beta = F.least((F.col("_d4") / n - norm) / (p * n), delta)
    usable = F.coalesce(n, F.lit(0.0)) >= 2
    shrink = F.when((F.col("p") <= 1) | (beta <= 0) | (delta <= 0), 0.0).otherwise(beta / delta)
    return stage(
        out.select(
            "rebalance_date",
            F.coalesce("n_days", F.lit(0)).alias("n_days"),
            "p",
            F.when(usable, mu).otherwise(0.0).alias("mu"),
            F.when(usable, shrink).otherwise(0.0).alias("shrink"),
        )
    )


def active_variance(active: DataFrame, windows: DataFrame, shrink: DataFrame, by: Sequence[str] = (), ridge: float = 1e-4, extra: Column | None = None) -> DataFrame:
    """``a'Σa`` per (scenario, rebalance) for rows with an active weight ``a``.

    ``extra`` is an additional diagonal variance per row (column expression over ``active``).
    """
    keys = [*by, "rebalance_date"]
    own = active.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("a")).alias("_aa"),
        F.sum((extra if extra is not None else F.lit(0.0)) * F.col("a") * F.col("a")).alias("_xa"),
    )
    daily = (
        active.select(*keys, "ts_code", "a")
        .join(windows.select("rebalance_date", "ts_code", "t", "x"), ["rebalance_date", "ts_code"])
        .groupBy(*keys, "t")
        .agg(F.sum(F.col("a") * F.col("x")).alias("_s"))
        .groupBy(*keys)
        .agg(*day_moments(F.col("_s")))
    )
    out = own.join(daily, keys, "left").join(shrink, "rebalance_date", "left")
    return out.select(*keys, shrunk_variance("", F.col("_aa"), F.col("_xa"), ridge).alias("active_variance"))


def day_moments(value: Column, name: str = "") -> list[Column]:
    """Count, mean and variance of a daily sum over the days it has rows on."""
    return [F.count(value).alias(f"_days{name}"), F.avg(value).alias(f"_mean{name}"), F.var_pop(value).alias(f"_var{name}")]


def shrunk_variance(name: str, squares: Column, extra: Column, ridge: float) -> Column:
    """``a'Σa`` from :func:`day_moments` (days without rows are zeros), the sum of squared weights and the shrinkage columns."""
    n = F.col("n_days").cast("double")
    days, mean, var = (F.coalesce(F.col(f"_{c}{name}").cast("double"), F.lit(0.0)) for c in ("days", "mean", "var"))
    whole = days * mean / n  # the mean over all days of the window
    spread = (days * (var + (mean - whole) * (mean - whole)) + (n - days) * whole * whole) / n
    s, mu = F.coalesce("shrink", F.lit(0.0)), F.coalesce("mu", F.lit(0.0))
    total = (1.0 - s) * F.when(n >= 2, spread).otherwise(0.0) + (s * mu + ridge) * squares + extra
    return F.greatest(total, F.lit(0.0))


def tracking_error(variance: Column) -> Column:
    """Annualised ex-ante tracking error."""
    return F.sqrt(F.greatest(variance, F.lit(0.0)) * YEAR)


def industry_exposure(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Portfolio and benchmark weight per industry."""
    return weights.groupBy(*by, "rebalance_date", "industry_name").agg(
        F.sum("weight").alias("exposure"), F.sum("benchmark_weight").alias("benchmark_exposure")
    )


def industry_deviation(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest absolute gap between portfolio and benchmark industry weight."""
    gap = F.abs(F.col("exposure") - F.col("benchmark_exposure"))
    return industry_exposure(weights, by).groupBy(*by, "rebalance_date").agg(F.max(gap).alias("max_industry_deviation"))


def snapshot_turnover(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Turnover counted over the current snapshot's codes only: a holding that left the
    universe does not count. ``weights`` must hold every snapshot code, zeros included."""
    keys = [*by, "rebalance_date"]
    seq = weights.select(*keys).distinct().withColumn("_seq", F.row_number().over(W.partitionBy(*by).orderBy("rebalance_date")))
    rows = weights.select(*keys, "ts_code", "weight").join(per_date(seq, by), keys)
    w = W.partitionBy(*by, "ts_code").orderBy("_seq")
    prev = F.when(F.lag("_seq").over(w) == F.col("_seq") - 1, F.lag("weight").over(w)).otherwise(0.0)
    rows = rows.withColumns({"_move": F.abs(F.col("weight") - prev), "_prev": prev})
    return rows.groupBy(*keys).agg(
        (F.sum("_move") / 2.0).alias("snapshot_turnover"), F.max("_seq").alias("_seq"), F.sum("_prev").alias("previous_held")
    ).drop("_seq")


def diagnostics(weights: DataFrame, windows: DataFrame, shrink: DataFrame, by: Sequence[str] = (), ridge: float = 1e-4, extra: Column | None = None) -> DataFrame:
    """Tracking error, industry deviation and snapshot turnover per (scenario, rebalance)."""
    keys = [*by, "rebalance_date"]
    active = weights.withColumn("a", F.col("weight") - F.col("benchmark_weight"))
    var = active_variance(active, windows, shrink, by, ridge, extra)
    out = var.join(industry_deviation(weights, by), keys).join(snapshot_turnover(weights, by), keys)
    return out.withColumn("ex_ante_tracking_error", tracking_error(F.col("active_variance")))


def check_constraints(weights: DataFrame, diag: DataFrame, limits: Limits, by: Sequence[str] = (), tol: float = 1e-6) -> DataFrame:
    """Which constraints each (scenario, rebalance) meets. The turnover limit binds only when
    some current code was held before."""
    keys = [*by, "rebalance_date"]
    book = weights.groupBy(*keys).agg(F.sum("weight").alias("_sum"), F.min("weight").alias("_min"), F.max("weight").alias("_max"))
    out = book.join(diag, keys)
    return out.select(
        *keys,
        (F.abs(F.col("_sum") - 1.0) <= tol).alias("fully_invested"),
        ((F.col("_min") >= -tol) & (F.col("_max") <= limits.max_weight + tol)).alias("weight_ok"),
        (F.col("active_variance") <= F.lit(limits.max_tracking_error**2 / YEAR) + tol * tol).alias("tracking_ok"),
        (F.col("max_industry_deviation") <= limits.max_industry_deviation + tol).alias("industry_ok"),
        ((F.col("previous_held") <= 0) | (F.col("snapshot_turnover") <= limits.max_turnover + tol)).alias("turnover_ok"),
    )


def objective(weights: DataFrame, diag: DataFrame, limits: Limits, by: Sequence[str] = (), gamma: float = 0.0) -> DataFrame:
    """``alpha·w - λ·a'Σa - κ·‖w - w_prev‖₁ - γ·Σ(1-c)w²`` per (scenario, rebalance)."""
    keys = [*by, "rebalance_date"]
    doubt = F.sum((1.0 - F.coalesce("confidence", F.lit(0.5))) * F.col("weight") * F.col("weight")) if gamma else F.lit(0.0)
    gain = weights.groupBy(*keys).agg(F.sum(F.col("alpha_score") * F.col("weight")).alias("_gain"), doubt.alias("_doubt"))
    value = (
        F.col("_gain")
        - limits.risk_aversion * F.col("active_variance")
        - limits.turnover_penalty * 2.0 * F.col("snapshot_turnover")
        - gamma * F.col("_doubt")
    )
    return gain.join(diag, keys).select(*keys, value.alias("objective"))


def half_width_variance(snapshot: DataFrame, shrink: DataFrame, tau: float = 1.0, by: Sequence[str] = (), ridge: float = 1e-4) -> DataFrame:
    """Add ``extra_variance``: interval half widths squared, scaled to the mean covariance diagonal.

    A missing half width takes the date's median; an unusable median counts as 1. The mean
    diagonal of the shrunk, ridged covariance is ``mu + ridge``.
    """
    from alphaloom.operators.cross_section import group_median

    keys = [*by, "rebalance_date"]
    rows = group_median(snapshot, keys, {"_med": F.col("ci_half_width")}, calendar_keyed=True)
    med = F.when(F.col("_med") > 0, F.col("_med")).otherwise(1.0)
    rows = rows.withColumn("_v", F.pow(F.coalesce("ci_half_width", med), F.lit(2.0)))
    mean = rows.groupBy(*keys).agg(F.avg("_v").alias("_mean"))
    rows = rows.join(per_date(mean, by), keys).join(F.broadcast(shrink.select("rebalance_date", "mu")), "rebalance_date", "left")
    scaled = F.when(F.col("_mean") > 0, tau * F.col("_v") / F.col("_mean") * (F.coalesce("mu", F.lit(0.0)) + ridge)).otherwise(0.0)
    return rows.withColumn("extra_variance", scaled).drop("_med", "_v", "_mean", "mu")
