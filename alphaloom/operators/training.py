"""Training windows and alpha estimators.

A :class:`TrainingPlan` is two calendar-sized tables: which dates train each window, and
which dates each window scores. The estimator contract is a function
``(panel, plan) -> Scores``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.calendar import expand_index_ranges, period_ends, trading_calendar
from alphaloom.operators.learners import Boosted, LinearModel, assembled, features_or_zero, linear, several
from alphaloom.operators.moments import least_squares, moments, pairs, solved, window_moments
from alphaloom.operators.staging import stage, written
from alphaloom.session import scratch_path

LABEL = "label_excess_return_20d"


@dataclass(frozen=True)
class TrainingPlan:
    """``windows``: (window_id, trade_date) training days; ``targets``: (window_id, trade_date) scored days;
    ``bounds``: one row per window with its date bounds."""

    windows: DataFrame
    targets: DataFrame
    bounds: DataFrame


@dataclass(frozen=True)
class Scores:
    """``predictions``: (trade_date, ts_code, label, ml_score); ``importance``: (trade_date, feature, importance)."""

    predictions: DataFrame
    importance: DataFrame


def rolling_plan(panel: DataFrame, train_months: int = 12, embargo: int | None = None, period: str = "month") -> TrainingPlan:
    """Windows ending at each period end with ``train_months`` earlier period ends.

    Without ``embargo`` a window trains on ``train_start <= d < predict date``, which lets
    forward labels leak; with it on ``train_start <= d <= calendar[idx(predict) - embargo]``,
    and windows whose cut-off is the first date or earlier are skipped.
    """
    calendar = stage(trading_calendar(panel))
    ends = period_ends(calendar, period).join(F.broadcast(calendar), "trade_date")
    order = W.orderBy("idx")
    last = F.col("idx") - (1 if embargo is None else embargo)
    bounds = ends.select(
        F.col("trade_date").alias("window_id"),
        F.lag("trade_date", train_months).over(order).alias("train_start"),
        F.lag("idx", train_months).over(order).alias("first_idx"),
        last.alias("last_idx"),
    ).where("first_idx IS NOT NULL")
    if embargo is not None:
        bounds = bounds.where("last_idx > 1")
    bounds = stage(bounds)
    days = expand_index_ranges(bounds.select("window_id", "first_idx", "last_idx"), calendar, F.col("first_idx"), F.col("last_idx"))
    targets = bounds.select("window_id", F.col("window_id").alias("trade_date"))
    return TrainingPlan(stage(days.select("window_id", "trade_date")), stage(targets), bounds)


def frozen_plan(panel: DataFrame, train_end: str, test_start: str, test_end: str | None = None, period: str = "month") -> TrainingPlan:
    """One window of all dates up to ``train_end``, scoring the period ends in [test_start, test_end]."""
    end, start = F.lit(train_end).cast("date"), F.lit(test_start).cast("date")
    dates = stage(trading_calendar(panel)).select("trade_date")
    days = dates.where(F.col("trade_date") <= end).select(end.alias("window_id"), "trade_date")
    test = dates.where(F.col("trade_date") >= start)
    if test_end is not None:
        test = test.where(F.col("trade_date") <= F.lit(test_end).cast("date"))
    targets = period_ends(test, period).select(end.alias("window_id"), "trade_date")
    bounds = days.groupBy("window_id").agg(F.min("trade_date").alias("train_start"))
    return TrainingPlan(stage(days), stage(targets), bounds)


def training_rows(panel: DataFrame, plan: TrainingPlan, label: str = LABEL) -> DataFrame:
    """Labelled panel rows once per window they train. The range condition was resolved on the
    calendar, so this is an equi join on the date with a calendar-sized table."""
    return panel.where(F.col(label).isNotNull()).join(F.broadcast(plan.windows), "trade_date")


def target_rows(panel: DataFrame, plan: TrainingPlan) -> DataFrame:
    """Cross-sections to score, with their window."""
    return panel.join(F.broadcast(plan.targets), "trade_date")


# --- estimators ---------------------------------------------------------------------------


def fit_rows(rows: DataFrame, features: Sequence[Column], y: Column, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """OLS per window from its rows; only moments are shuffled."""
    return least_squares(rows, features, y, keys)


def ols_alpha(panel: DataFrame, plan: TrainingPlan, features: Sequence[str], label: str = LABEL, min_train_rows: int = 2000) -> Scores:
    """OLS per window from daily moments: overlapping windows share one pass over the panel."""
    x = features_or_zero(features)
    daily = stage(moments(panel.where(F.col(label).isNotNull()), ["trade_date"], x, F.col(label)))
    sums = window_moments(daily, plan.windows, len(x))
    coef = stage(solved(sums, len(x), ["window_id"]).where(F.col("n_train") >= min_train_rows))
    model = LinearModel(tuple(features), coef)
    predictions = model.predict(target_rows(panel, plan), "ml_score").select("trade_date", "ts_code", label, "ml_score")
    importance = plan.targets.join(model.importance(), "window_id").select("trade_date", "feature", "importance")
    return Scores(predictions, importance)


def ols_variants(panel: DataFrame, plan: TrainingPlan, variants: Mapping[str, Sequence[str]], label: str = LABEL, min_train_rows: int = 2000) -> Scores:
    """OLS of several feature sets, labelled by ``variant``: all are solved from one table of window moments over every feature."""
    features = list(dict.fromkeys(f for chosen in variants.values() for f in chosen))
    x, p = features_or_zero(features), len(features)
    daily = stage(moments(panel.where(F.col(label).isNotNull()), ["trade_date"], x, F.col(label)))
    sums = window_moments(daily, plan.windows, p)
    found = []
    for name, chosen in variants.items():
        at = [*[features.index(f) for f in chosen], p]
        own = {f"m{i}": F.col(f"m{a}") for i, a in enumerate(at)}
        own |= {f"c{i}_{j}": F.col(f"c{min(at[i], at[j])}_{max(at[i], at[j])}") for i, j in pairs(len(chosen))}
        coef = solved(sums.select("window_id", "n", *[c.alias(k) for k, c in own.items()]), len(chosen), ["window_id"])
        found.append(coef.where(F.col("n_train") >= min_train_rows).withColumn("variant", F.lit(name)))
    coef = stage(reduce(DataFrame.unionByName, found))
    rows = target_rows(panel, plan).join(coef, "window_id")
    value = F.coalesce(*[F.when(F.col("variant") == n, linear(features_or_zero(chosen))) for n, chosen in variants.items()])
    predictions = rows.select("variant", "trade_date", "ts_code", label, value.alias("ml_score"))
    each = [
        F.when(F.col("variant") == n, F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col("coef")[i + 1]).alias("importance")) for i, f in enumerate(chosen)]))
        for n, chosen in variants.items()
    ]
    importance = plan.targets.join(coef, "window_id").select("variant", "trade_date", F.inline(F.coalesce(*each)))
    return Scores(predictions, importance)


BoostParams = Boosted


def boosted_alpha(
    panel: DataFrame, plan: TrainingPlan, features: Sequence[str], label: str = LABEL, min_train_rows: int = 2000, params: Boosted = Boosted(), store: str | None = None
) -> Scores:
    """Boosted trees per window with Spark ML, ``params.at_once`` windows at a time; each fit is itself a distributed job.

    Features are assembled once, into a table in date order of which a window reads its own files.
    Scores and importances of a window are written under ``store`` as soon as it is fitted; a
    restart with the same ``store`` goes on with the windows that are missing there.
    """
    spark = panel.sparkSession
    sizes = panel.where(F.col(label).isNotNull()).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    spans = (
        plan.windows.join(sizes, "trade_date")
        .groupBy("window_id")
        .agg(F.sum("n").alias("n"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
        .where(F.col("n") >= min_train_rows)
        .orderBy("window_id")
        .collect()
    )
    rows = stage(assembled(panel, features).select("trade_date", "ts_code", label, "_x").repartitionByRange("trade_date").sortWithinPartitions("trade_date"))
    folder = store or scratch_path(spark, "boosted")

    def one(span) -> tuple[str, str]:
        scores, weights = (f"{folder}/{kind}/{span.window_id}" for kind in ("scores", "importance"))
        if not (written(spark, scores) and written(spark, weights)):
            train = rows.where(F.col("trade_date").between(span.a, span.b) & F.col(label).isNotNull())
            train = train.join(plan.windows.where(F.col("window_id") == F.lit(span.window_id)).select("trade_date"), "trade_date", "left_semi")
            model = params.estimator().setFeaturesCol("_x").setLabelCol(label).setPredictionCol("ml_score").fit(train)
            targets = plan.targets.where(F.col("window_id") == F.lit(span.window_id)).select("trade_date")
            scored = model.transform(rows.join(targets, "trade_date")).select("trade_date", "ts_code", label, "ml_score")
            scored.write.mode("overwrite").parquet(scores)
            each = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance")) for f, v in zip(features, model.featureImportances.toArray())])
            targets.select("trade_date", F.inline(each)).write.mode("overwrite").parquet(weights)
        return scores, weights

    made = several(spans, one, params.at_once)
    if not made:
        none = panel.where("false").select("trade_date", "ts_code", label, F.lit(None).cast("double").alias("ml_score"))
        return Scores(none, spark.createDataFrame([], "trade_date date, feature string, importance double"))
    scores, weights = zip(*made)
    return Scores(spark.read.parquet(*scores), spark.read.parquet(*weights))
