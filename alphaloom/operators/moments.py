"""Least squares from centred moments that merge.

A moment row has ``n``, the means ``m0..mp`` of the features and the target (the last) and their
centred sums of products ``c<i>_<j>``. Rows are merged by the means' distances to the common
mean, never by differences of raw sums, so values with a large mean and a small spread lose nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.operators.staging import stage

#: below this share of the largest eigenvalue of the correlations a direction has no spread
RANK = 1e-12


def pairs(p: int) -> list[tuple[int, int]]:
    """Index pairs (i <= j) of ``p`` features and the target."""
    return [(i, j) for i in range(p + 1) for j in range(i, p + 1)]


def moments(rows: DataFrame, keys: Sequence[str], features: Sequence[Column], y: Column) -> DataFrame:
    """``keys``, ``n``, means and centred sums of products of the rows without a NULL; merged map-side."""
    z = [*features, y]
    cols = [c.cast("double").alias(f"z{i}") for i, c in enumerate(z)]
    rows = rows.select(*keys, *cols).where(" AND ".join(f"z{i} IS NOT NULL" for i in range(len(z))))
    products = [(F.covar_pop(f"z{i}", f"z{j}") if i != j else F.var_pop(f"z{i}")).alias(f"c{i}_{j}") for i, j in pairs(len(features))]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(len(z))], *products)
    return out.withColumns({f"c{i}_{j}": F.col(f"c{i}_{j}") * F.col("n") for i, j in pairs(len(features))})


def merged(parts: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Moments of each group of moment rows. ``parts`` is read twice."""
    keys = list(keys)
    centre = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"_m{i}") for i in range(p + 1)])
    off = [F.col(f"m{i}") - F.col(f"_m{i}") for i in range(p + 1)]
    rows = parts.join(centre, keys)
    out = rows.groupBy(*keys, "_n", *[f"_m{i}" for i in range(p + 1)]).agg(
        *[F.sum(F.col(f"c{i}_{j}") + F.col("n") * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs(p)]
    )
    return out.withColumnsRenamed({"_n": "n", **{f"_m{i}": f"m{i}" for i in range(p + 1)}})


def _solver(p: int):
    import numpy as np

    @F.pandas_udf("array<double>")
    def solve(moments: pd.Series) -> pd.Series:
        v = np.stack(moments.to_numpy()) if len(moments) else np.zeros((0, p + 1 + len(pairs(p))))
        means, c = v[:, : p + 1], np.zeros((len(v), p + 1, p + 1))
        for k, (i, j) in enumerate(pairs(p)):
            c[:, i, j] = c[:, j, i] = v[:, p + 1 + k]
        spread = np.sqrt(np.maximum(np.diagonal(c[:, :p, :p], axis1=1, axis2=2), 0.0))
        scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)
        xx = c[:, :p, :p] * scale[:, :, None] * scale[:, None, :]  # correlations: the rank does not depend on units
        slopes = (np.linalg.pinv(xx, rcond=RANK, hermitian=True) @ (c[:, :p, p] * scale)[:, :, None])[:, :, 0] * scale
        level = means[:, p] - (slopes * means[:, :p]).sum(axis=1)
        return pd.Series(list(np.column_stack([level, slopes])), index=moments.index)

    return solve


def solved(table: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``n_train`` and ``coef`` (intercept first) of each moment row; directions without spread get no slope."""
    if p == 1:
        slope = F.coalesce(F.try_divide(F.col("c0_1"), F.col("c0_0")), F.lit(0.0))
        coef = F.array(F.col("m1") - slope * F.col("m0"), slope)
    else:
        coef = _solver(p)(F.array(*[f"m{i}" for i in range(p + 1)], *[f"c{i}_{j}" for i, j in pairs(p)]))
    return table.select(*keys, F.col("n").cast("long").alias("n_train"), coef.alias("coef"))


def least_squares(rows: DataFrame, features: Sequence[Column], y: Column, keys: Sequence[str]) -> DataFrame:
    """Coefficients per group of ``rows``; only moments are shuffled."""
    return solved(moments(rows, keys, features, y), len(features), keys)


def window_moments(parts: DataFrame, windows: DataFrame, p: int, where: str = "true") -> DataFrame:
    """Staged moments per ``window_id`` from daily ``parts``: overlapping windows share one pass over the rows."""
    return stage(merged(parts.join(windows, "trade_date").where(where), ["window_id"], p))
