"""Learners of windowed regressions behind one contract.

``Learner.fit(windows, features, target)`` fits a model on the proper part of every window;
the fitted model scores any rows that carry a ``window_id`` and tells the importance of
features. A target is the label, or the log of the absolute residual of another fitted model,
so that any learner can be the base of conformal intervals and any other its spread.

* :class:`LeastSquares` — closed form; all windows share one pass over the rows, for labels and for residuals of another
  least-squares model alike.
* :class:`Forest`, :class:`Boosted` — Spark ML trees, one fit for each window, several at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.operators.moments import least_squares, merged, solved
from alphaloom.operators.split import SplitWindows
from alphaloom.operators.staging import stage

EPS = 1e-6


class Model(Protocol):
    """One fitted regression for each window."""

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows`` of the fitted windows with the column ``out``; rows of other windows are dropped."""

    def importance(self) -> DataFrame:
        """(window_id, feature, importance)."""


class Learner(Protocol):
    def fit(self, windows: SplitWindows, features: Sequence[str], target: Target) -> Model: ...


@dataclass(frozen=True)
class Target:
    """The label, or ``log(|label - base's prediction| + EPS)`` where there is a ``base``."""

    label: str
    base: Model | None = None

    def of(self, rows: DataFrame, out: str = "_target") -> DataFrame:
        """``rows`` (with ``window_id``) with the target's value."""
        if self.base is None:
            return rows.withColumn(out, F.col(self.label).cast("double"))
        scored = self.base.predict(rows, "_fitted")
        return scored.withColumn(out, F.log(F.abs(F.col(self.label) - F.col("_fitted")) + EPS)).drop("_fitted")


def features_or_zero(features: Sequence[str]) -> list[Column]:
    """Standardised features; a missing one takes the cross-section mean, 0."""
    return [F.coalesce(F.col(c), F.lit(0.0)) for c in features]


def linear(features: Sequence[Column], coef: str = "coef") -> Column:
    out = F.col(coef)[0]
    for i, f in enumerate(features):
        out = out + F.col(coef)[i + 1] * f
    return out


# --- least squares ------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    """``table``: (window_id, n_train, coef); ``moments`` of the windows it was fitted on, if it was fitted on their labels."""

    features: tuple[str, ...]
    table: DataFrame
    moments: DataFrame | None = None

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        coef = self.table.select("window_id", F.col("coef").alias("_coef"))
        return rows.join(coef, "window_id").withColumn(out, linear(features_or_zero(self.features), "_coef")).drop("_coef")

    def importance(self) -> DataFrame:
        each = [F.struct(F.lit(f).alias("feature"), F.abs(F.col("coef")[i + 1]).alias("importance")) for i, f in enumerate(self.features)]
        return self.table.select("window_id", F.inline(F.array(*each)))


@dataclass(frozen=True)
class LeastSquares:
    """Ordinary least squares with an intercept; a missing feature counts as 0."""

    def fit(self, windows: SplitWindows, features: Sequence[str], target: Target) -> LinearModel:
        x, features = features_or_zero(features), tuple(features)
        if target.base is None:
            table = windows.proper_moments(x, F.col(target.label))
            return LinearModel(features, stage(solved(table, len(x), ["window_id"])), table)
        if isinstance(target.base, LinearModel) and target.base.moments is not None and target.base.features == features:
            return LinearModel(features, stage(solved(_residual_moments(windows, target.base, target.label), len(x), ["window_id"])))
        return LinearModel(features, stage(least_squares(target.of(windows.proper()), x, F.col("_target"), ["window_id"])))


def _residual_moments(windows: SplitWindows, base: LinearModel, label: str) -> DataFrame:
    """Moments of each window's proper part with the log residual of ``base`` as target, from one pass over the rows.

    The features' own products are those ``base`` was fitted with; each task adds up the log
    residual's products with the features for all windows a row is in, a row at most once each.
    """
    p = len(base.features)
    coef = {r["window_id"]: r["coef"] for r in base.table.select("window_id", "coef").collect()}  # a row per window
    spans = [(w, days, cut, coef[w]) for w, days, cut in windows.spans if w in coef]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        known = [(np.array(days), cut, np.array(b)) for _, days, cut, b in spans]
        total = [(0, np.zeros(p + 1), np.zeros(p + 1)) for _ in spans]
        for batch in batches:
            v = batch.to_numpy(dtype=float)
            v = v[np.argsort(v[:, 0], kind="stable")]
            for k, (days, cut, b) in enumerate(known):
                rows = v[np.searchsorted(v[:, 0], days[0]) : np.searchsorted(v[:, 0], days[-1], "right")]
                rows = rows[rows[:, 1] > cut]
                if len(days) <= days[-1] - days[0]:
                    rows = rows[np.isin(rows[:, 0], days)]
                if not len(rows):
                    continue
                z = rows[:, 2:].copy()
                z[:, p] = np.log(np.abs(z[:, p] - b[0] - z[:, :p] @ b[1:]) + EPS)
                n, mean = len(z), z.mean(axis=0)
                c = ((z - mean) * (z[:, p:] - mean[p])).sum(axis=0)
                old_n, old_mean, old_c = total[k]
                off, all_n = mean - old_mean, old_n + n
                total[k] = all_n, old_mean + off * n / all_n, old_c + c + off * off[p] * old_n * n / all_n
        rows = [(k, n, *mean, *c) for k, (n, mean, c) in enumerate(total) if n]
        yield pd.DataFrame(rows, columns=["w", "n", *[f"m{i}" for i in range(p + 1)], *[f"c{i}_{p}" for i in range(p + 1)]])

    cells = ", ".join([*[f"m{i} DOUBLE" for i in range(p + 1)], *[f"c{i}_{p} DOUBLE" for i in range(p + 1)]])
    source = windows.rows.select(F.unix_date("trade_date").alias("_day"), "_key", *[c.cast("double").alias(f"z{i}") for i, c in enumerate(features_or_zero(base.features))], F.col(label).cast("double").alias(f"z{p}"))
    found = source.mapInPandas(add, f"w INT, n BIGINT, {cells}")
    named = F.array(*[F.lit(w) for w, *_ in spans]) if spans else F.array().cast("array<date>")
    parts = found.select(named[F.col("w")].alias("window_id"), "*", *[F.lit(0.0).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)])
    own = base.moments.select("window_id", *[F.col(f"c{i}_{j}").alias(f"own{i}_{j}") for i in range(p) for j in range(i, p)])
    return merged(stage(parts), ["window_id"], p).join(own, "window_id").withColumns({f"c{i}_{j}": F.col(f"own{i}_{j}") for i in range(p) for j in range(i, p)})


# --- trees --------------------------------------------------------------------------------


def several(windows: Sequence, run: Callable, at_once: int) -> list:
    """``run`` of every window, ``at_once`` at a time; Spark shares the cluster between their jobs."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(inheritable_thread_target(run), windows))


def assembled(rows: DataFrame, features: Sequence[str], out: str = "_x") -> DataFrame:
    """``rows`` with the features, missing ones as 0, as one vector."""
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn(out, array_to_vector(F.array(*[c.cast("double") for c in features_or_zero(features)])))


@dataclass(frozen=True)
class TreeModel:
    """A Spark ML model for each window."""

    features: tuple[str, ...]
    models: dict
    at_once: int

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """Scores are staged window by window, so no plan holds the trees of more than one window."""
        rows = assembled(rows, self.features)

        def one(window):
            model = self.models[window].setPredictionCol(out)
            return stage(model.transform(rows.where(F.col("window_id") == F.lit(window))).drop("_x"))

        parts = several(sorted(self.models), one, self.at_once)
        return reduce(DataFrame.unionByName, parts) if parts else rows.where("false").drop("_x").withColumn(out, F.lit(None).cast("double"))

    def importance(self) -> DataFrame:
        rows = [(w, f, float(v)) for w, m in sorted(self.models.items()) for f, v in zip(self.features, m.featureImportances.toArray())]
        return SparkSession.getActiveSession().createDataFrame(rows, "window_id date, feature string, importance double")


@dataclass(frozen=True)
class _Trees:
    """Settings that both kinds of trees share; ``at_once`` windows are fitted at the same time."""

    at_once: int = field(default=4, kw_only=True)

    def estimator(self):
        raise NotImplementedError

    def fit(self, windows: SplitWindows, features: Sequence[str], target: Target) -> TreeModel:
        needed = ["window_id", "trade_date", target.label, *features]

        def one(window):
            rows = target.of(windows.proper(window).select(*dict.fromkeys(needed)))
            return self.estimator().setFeaturesCol("_x").setLabelCol("_target").fit(assembled(rows, features))

        names = [w for w, _, _ in windows.spans]
        return TreeModel(tuple(features), dict(zip(names, several(names, one, self.at_once))), self.at_once)


@dataclass(frozen=True)
class Forest(_Trees):
    """Random forest: every tree of a window grows in the same few passes."""

    trees: int = 100
    depth: int = 5
    subsample: float = 0.8
    features_per_split: str = "0.8"
    seed: int = 42

    def shallower(self) -> Forest:
        """The learner of residuals that goes with this one: half the trees, one level less."""
        return replace(self, trees=max(1, self.trees // 2), depth=max(1, self.depth - 1), seed=self.seed + 1)

    def estimator(self):
        from pyspark.ml.regression import RandomForestRegressor

        return RandomForestRegressor(
            numTrees=self.trees, maxDepth=self.depth, subsamplingRate=self.subsample, featureSubsetStrategy=self.features_per_split, seed=self.seed
        )


@dataclass(frozen=True)
class Boosted(_Trees):
    """Gradient-boosted trees; 31 leaves correspond to depth 5."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 5
    subsample: float = 0.8
    features_per_split: str = "0.8"
    seed: int = 42

    def shallower(self) -> Boosted:
        """The learner of residuals that goes with this one: half the rounds, one level less."""
        return replace(self, rounds=max(1, self.rounds // 2), depth=max(1, self.depth - 1), seed=self.seed + 1)

    def estimator(self):
        from pyspark.ml.regression import GBTRegressor

        return GBTRegressor(
            maxIter=self.rounds, stepSize=self.step, maxDepth=self.depth, subsamplingRate=self.subsample,
            featureSubsetStrategy=self.features_per_split, seed=self.seed,
        )
