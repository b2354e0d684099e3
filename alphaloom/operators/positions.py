"""Position tables: top-N books, turnover, blends.

A position row is keyed by (scenario columns, rebalance_date, ts_code). ``by`` names the
scenario columns, so any number of variants runs in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.calendar import period_ends
from alphaloom.operators.joins import first_row
from alphaloom.operators.staging import per_date

MIN_WEIGHT = 1e-6


def snapshots(panel: DataFrame, score: str = "score", period: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Scored rows on rebalance dates; ``trade_date`` becomes ``rebalance_date``.

    Rebalance dates come from all dates of the panel; a date without any scored row just
    yields no rows.
    """
    ends = period_ends(panel, period).select("trade_date")
    rows = panel.join(F.broadcast(ends), "trade_date", "left_semi").where(F.col(score).isNotNull())
    return rows.withColumnRenamed("trade_date", "rebalance_date")


def top_n(snapshot: DataFrame, n: int, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Equal-weighted N best rows per rebalance date; ties go to the smaller code.

    ``rank <= n`` is applied per task before the shuffle, so a date's candidates never meet
    in full.
    """
    keys = [*by, "rebalance_date"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("ts_code")))
    best = snapshot.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return best.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(*keys)))


def top_n_grid(snapshot: DataFrame, sizes: Sequence[int], score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Several book sizes at once, labelled by the column ``top_n``."""
    keys = [*by, "rebalance_date"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("ts_code")))
    best = snapshot.withColumn("_rank", rank).where(F.col("_rank") <= max(sizes))
    books = best.withColumn("top_n", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("_rank <= top_n").drop("_rank")
    return books.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy("top_n", *keys)))


def turnover(positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way turnover per rebalance over the union of old and new codes; the first is half the book.

    Each holding looks one rebalance back and ahead within its own (scenario, code) history,
    which replaces a full outer join of consecutive books.
    """
    by = list(by)
    seq = positions.select(*by, "rebalance_date").distinct()
    seq = seq.withColumn("_seq", F.row_number().over(W.partitionBy(*by).orderBy("rebalance_date")))
    held = positions.select(*by, "rebalance_date", "ts_code", "weight").join(per_date(seq, by), [*by, "rebalance_date"])
    w = W.partitionBy(*by, "ts_code").orderBy("_seq")
    prev = F.when(F.lag("_seq").over(w) == F.col("_seq") - 1, F.lag("weight").over(w)).otherwise(0.0)
    leaves = F.coalesce(F.lead("_seq").over(w) != F.col("_seq") + 1, F.lit(True))
    moves = held.select(
        *by,
        F.array(
            F.struct(F.col("_seq").alias("_seq"), F.abs(F.col("weight") - prev).alias("_move")),
            F.struct((F.col("_seq") + 1).alias("_seq"), F.when(leaves, F.abs("weight")).alias("_move")),
        ).alias("_m"),
    ).select(*by, F.inline("_m"))
    total = moves.where("_move IS NOT NULL").groupBy(*by, "_seq").agg((F.sum("_move") / 2.0).alias("turnover"))
    return seq.join(total, [*by, "_seq"]).select(*by, "rebalance_date", "turnover")


def with_turnover(positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach each rebalance's turnover."""
    return positions.join(per_date(turnover(positions, by), by), [*by, "rebalance_date"])


def equal_weight_book(panel: DataFrame, n: int = 20, score: str = "score", period: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Top-N positions with turnover in the standard position layout."""
    book = with_turnover(top_n(snapshots(panel, score, period), n, score, by), by)
    for c, t in (("benchmark_weight", "double"), ("industry_name", "string")):
        if c not in book.columns:
            book = book.withColumn(c, F.lit(None).cast(t))
    return book.select(
        *by,
        "rebalance_date",
        "ts_code",
        "weight",
        F.col(score).alias("score"),
        "benchmark_weight",
        "industry_name",
        "turnover",
        F.lit(None).cast("double").alias("ex_ante_tracking_error"),
        F.lit(None).cast("double").alias("max_industry_deviation"),
        F.lit("equal_weight").alias("optimization_status"),
    )


def prepare_snapshot(snapshot: DataFrame, score: str = "score", by: Sequence[str] = (), unknown: str = "UNKNOWN") -> DataFrame:
    """One row per code with benchmark weights summing to 1 and alpha as population z-score.

    A date whose benchmark weights do not sum above 0 gets equal weights; no spread of the
    score gives alpha 0.
    """
    keys = [*by, "rebalance_date"]
    rows = snapshot.where(F.col(score).isNotNull())
    rows = first_row(rows, [*keys, "ts_code"], [F.col(score).desc(), F.col("benchmark_weight").desc_nulls_last()])
    rows = rows.withColumns({"benchmark_weight": F.coalesce("benchmark_weight", F.lit(0.0)), "industry_name": F.coalesce("industry_name", F.lit(unknown))})
    stats = rows.groupBy(*keys).agg(
        F.sum("benchmark_weight").alias("_wb"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(score).alias("_m"),
        F.stddev_pop(score).alias("_s"),
    )
    rows = rows.join(per_date(stats, by), keys)
    return rows.withColumns(
        {
            "benchmark_weight": F.when(F.col("_wb") > 0, F.col("benchmark_weight") / F.col("_wb")).otherwise(F.lit(1.0) / F.col("_n")),
            "alpha_score": F.when(F.col("_s") > 0, (F.col(score) - F.col("_m")) / F.col("_s")).otherwise(0.0),
        }
    ).drop("_wb", "_n", "_m", "_s")


def blend(a: DataFrame, b: DataFrame, trust: DataFrame, default: float = 0.5) -> DataFrame:
    """``g·w_a + (1-g)·w_b`` per rebalance date over the union of codes, scaled to sum 1, with turnover.

    ``trust`` has one row per date (``rebalance_date``, ``trust``); dates without one use ``default``.
    """
    keys = ["rebalance_date", "ts_code"]
    both = a.select(*keys, F.col("weight").alias("_a")).join(b.select(*keys, F.col("weight").alias("_b")), keys, "full")
    both = both.join(F.broadcast(trust.select("rebalance_date", "trust")), "rebalance_date", "left")
    g = F.coalesce("trust", F.lit(default))
    mixed = both.select(*keys, (g * F.coalesce("_a", F.lit(0.0)) + (1 - g) * F.coalesce("_b", F.lit(0.0))).alias("weight"))
    total = mixed.groupBy("rebalance_date").agg(F.sum("weight").alias("_sum")).where("_sum > 0")
    mixed = mixed.join(F.broadcast(total), "rebalance_date").withColumn("weight", F.col("weight") / F.col("_sum")).drop("_sum")
    return with_turnover(mixed)


def add_scenarios(df: DataFrame, scenarios: Sequence[dict], name: str = "scenario") -> DataFrame:
    """Repeat each row once per scenario of a fixed list, adding its settings as columns."""
    fields = list(scenarios[0])
    rows = F.array(*[F.struct(*[_literal(s[f]).alias(f) for f in fields]) for s in scenarios])
    return df.select("*", F.inline(rows))


def _literal(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(v)
