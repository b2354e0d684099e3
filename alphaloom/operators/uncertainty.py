"""Uses of interval confidence in portfolio construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.columns import clip, to_double
from alphaloom.operators.cross_section import fill_median
from alphaloom.operators.order_stats import keep_top, tie_key

MISSING = 0.5


def prepare_confidence(snapshot: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Numeric confidence in [0, 1]: NULL takes the date's median, then 0.5. A snapshot without
    the column is returned as it is, which means the plain scheme."""
    if "confidence" not in snapshot.columns:
        return snapshot
    rows = snapshot.withColumn("confidence", to_double(F.col("confidence")))
    rows = fill_median(rows, [*by, "rebalance_date"], "confidence", calendar_keyed=True)
    return rows.withColumn("confidence", F.coalesce(clip(F.col("confidence"), 0.0, 1.0), F.lit(MISSING)))


def alpha_scale(snapshot: DataFrame, beta: float = 1.0) -> DataFrame:
    """Alpha times ``confidence^beta``."""
    return snapshot.withColumn("alpha_score", F.col("alpha_score") * F.pow("confidence", F.lit(float(beta))))


def candidate_filter(snapshot: DataFrame, top_pct: float = 0.7, min_candidates: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """The most confident ``max(ceil(n·top_pct), min(min_candidates, n))`` rows of each date."""
    if top_pct >= 1.0:
        return snapshot

    def size(n):
        return F.greatest(F.ceil(n * F.lit(top_pct)), F.least(F.lit(min_candidates), n))

    return keep_top(snapshot, [*by, "rebalance_date"], F.col("confidence"), tie_key(snapshot, "ts_code"), size, calendar_keyed=True)


def average_confidence(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean confidence of each portfolio."""
    w = F.col("weight") + 1e-12
    return weights.groupBy(*by, "rebalance_date").agg((F.sum(F.col("confidence") * w) / F.sum(w)).alias("avg_confidence"))
