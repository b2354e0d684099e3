"""Experiment tables: ablations, sensitivity, seeds, schemes, regimes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.operators import risk
from alphaloom.operators.calendar import period_ends, trading_calendar
from alphaloom.operators.conformal import (
    conformal_predictions,
    realised_correlation,
    sign_tilt,
    trust_gate,
)
from alphaloom.operators.cross_section import composite_score
from alphaloom.operators.factors import DEFAULT_GROUPS, FEATURE_GROUPS, resolve_features
from alphaloom.operators.learners import several
from alphaloom.operators.metrics import performance_metrics
from alphaloom.operators.nav import slice_nav
from alphaloom.operators.positions import (
    add_scenarios,
    blend,
    prepare_snapshot,
    snapshots,
    top_n,
    top_n_grid,
    with_turnover,
)
from alphaloom.operators.reports import pivot_metric, union_labelled
from alphaloom.operators.staging import stage
from alphaloom.operators.training import TrainingPlan, ols_variants, rolling_plan
from alphaloom.operators.uncertainty import alpha_scale, candidate_filter, prepare_confidence
from alphaloom.plans.backtest import Backtest, from_positions, tilted_positions

SEEDS = (7, 42, 123, 2024, 314159)
# Fixed constraint sets: a limit of 10 never binds.
CONSTRAINT_SETS = (
    {"scenario": "full_constraints", "max_tracking_error": 0.08, "max_industry_deviation": 0.02, "max_turnover": 0.20},
    {"scenario": "no_tracking_error", "max_tracking_error": 10.0, "max_industry_deviation": 0.02, "max_turnover": 0.20},
    {"scenario": "no_industry_deviation", "max_tracking_error": 0.08, "max_industry_deviation": 10.0, "max_turnover": 0.20},
    {"scenario": "no_turnover", "max_tracking_error": 0.08, "max_industry_deviation": 0.02, "max_turnover": 10.0},
)
SUMMARY = ("information_ratio", "sharpe_ratio", "annual_excess_return", "max_drawdown", "annual_turnover", "tracking_error")


def ablation_scores(panel: DataFrame, variants: Mapping[str, Sequence[str]]) -> DataFrame:
    """Month-end rows once per variant with that variant's composite score."""
    ends = period_ends(panel).select("trade_date")
    rows = panel.join(F.broadcast(ends), "trade_date", "left_semi")
    scores = F.array(*[F.struct(F.lit(n).alias("variant"), F.round(composite_score(cols), 8).alias("score")) for n, cols in variants.items()])
    rows = rows.select("trade_date", "ts_code", F.inline(scores))
    return rows.where("score IS NOT NULL").withColumnRenamed("trade_date", "rebalance_date")


# Fixed variants of the ablation, by feature group.
VARIANTS = {
    "fundamental_only": ("value", "quality"),
    "technical_only": ("technical", "liquidity"),
    "full_factor": DEFAULT_GROUPS,
}


def variant_features(columns: Sequence[str], variants: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Features of each variant (name -> feature groups) that a panel with these ``columns`` has.

    Without ``variants`` the fixed ones are compared, and on a panel with every external series
    also the full one with them.
    """
    chosen = dict(variants or VARIANTS)
    if variants is None and set(FEATURE_GROUPS["external"]) <= set(columns):
        chosen["full_with_external"] = (*DEFAULT_GROUPS, "external")
    return {name: resolve_features(groups, available=columns) for name, groups in chosen.items()}


def feature_ablation(panel: DataFrame, variants: Mapping[str, Sequence[str]], n: int = 20) -> Backtest:
    """All feature-group variants in one back-test, labelled by ``variant``."""
    book = with_turnover(top_n(ablation_scores(panel, variants), n, by=["variant"]), ["variant"])
    run = from_positions(panel, no_risk(book), ["variant"])
    about = {name: (len(cols), ",".join(cols)) for name, cols in variants.items()}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in about.items() for x in (k, v[i])]), F.col("variant"))
    metrics = run.metrics.withColumns({"feature_count": pick(0), "feature_columns": pick(1)})
    return Backtest(run.nav, run.positions, metrics, run.by)


def model_ablation(panel: DataFrame, plan: TrainingPlan, variants: Mapping[str, Sequence[str]], n: int = 20, min_train_rows: int = 2000) -> Backtest:
    """Equal-weight books of the model score of every feature set, labelled by ``variant``; all models come from one pass over the panel."""
    scores = ols_variants(panel, plan, variants, min_train_rows=min_train_rows).predictions
    scores = scores.select("variant", F.col("trade_date").alias("rebalance_date"), "ts_code", F.round("ml_score", 8).alias("score"))
    book = with_turnover(top_n(scores, n, by=["variant"]), ["variant"])
    run = from_positions(panel, no_risk(book), ["variant"])
    about = {name: (len(cols), ",".join(cols)) for name, cols in variants.items()}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in about.items() for x in (k, v[i])]), F.col("variant"))
    return Backtest(run.nav, run.positions, run.metrics.withColumns({"feature_count": pick(0), "feature_columns": pick(1)}), run.by)


def no_risk(book: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return book.withColumns({"ex_ante_tracking_error": none, "max_industry_deviation": none})


def top_n_sensitivity(panel: DataFrame, sizes: Sequence[int] = (10, 20, 30, 50)) -> Backtest:
    """Book sizes side by side, labelled by ``top_n``."""
    book = with_turnover(top_n_grid(snapshots(panel), sizes), ["top_n"])
    return from_positions(panel, no_risk(book), ["top_n"])


def constraint_ablation(prepared: DataFrame, panel: DataFrame, limits: risk.Limits = risk.Limits(), sets: Sequence[dict] = CONSTRAINT_SETS) -> Backtest:
    """Full limits against one limit lifted at a time."""
    caps = {s["scenario"]: s["max_turnover"] for s in sets}
    rows = add_scenarios(prepared, [{k: x for k, x in s.items() if k != "max_turnover"} for s in sets])
    positions = tilted_positions(stage(rows), panel, limits, ["scenario"], max_turnover=caps)
    return from_positions(panel, positions, ["scenario"])


def seed_runs(panel: DataFrame, features: Sequence[str], split_key, seeds: Sequence[int] = SEEDS, n: int = 20, **conformal) -> Backtest:
    """Equal-weight books of the model score under several calibration seeds, labelled by ``seed``.

    The seeds have the same windows and run at the same time, as most of their jobs are short.
    """
    plan = conformal.pop("plan", None) or rolling_plan(panel, conformal.get("train_months", 12), conformal.get("embargo", 20))

    def one(s: int) -> DataFrame:
        pred = conformal_predictions(panel, features, split_key=split_key(s), plan=plan, **conformal).predictions
        return pred.select(F.col("trade_date").alias("rebalance_date"), "ts_code", F.round("ml_score", 8).alias("score"))

    scores = stage(union_labelled(list(zip(seeds, several(seeds, one, len(seeds)))), "seed"))
    book = with_turnover(top_n(scores, n, by=["seed"]), ["seed"])
    return from_positions(panel, no_risk(book), ["seed"])


def scheme_snapshots(panel: DataFrame, pred: DataFrame, shrink: DataFrame, min_candidates: int = 30) -> DataFrame:
    """Optimiser snapshots of every uncertainty scheme, stacked under ``scheme``.

    ``panel`` needs benchmark_weight and industry_name; ``pred`` is the conformal layout.
    """
    cols = ["ml_score", "ci_half_width", "confidence"]
    rows = panel.select("trade_date", "ts_code", "industry_name", "benchmark_weight").join(pred.select("trade_date", "ts_code", *cols), ["trade_date", "ts_code"])
    rows = rows.withColumnRenamed("trade_date", "rebalance_date").withColumn("score", F.col("ml_score"))
    base = stage(prepare_confidence(prepare_snapshot(rows)))
    dates = pred.select("trade_date").distinct()
    tilted = sign_tilt(pred, realised_correlation(pred, trading_calendar(panel), dates)).select(
        F.col("trade_date").alias("rebalance_date"), "ts_code", F.col("score").alias("_s")
    )
    signed = base.join(tilted, ["rebalance_date", "ts_code"]).withColumn("score", F.col("_s")).drop("_s", "alpha_score")
    zero = {"gamma": F.lit(0.0), "extra_variance": F.lit(0.0)}
    filtered = candidate_filter(base, min_candidates=min_candidates)
    parts = [
        ("conformal_ml_baseline", base.withColumns(zero)),
        ("alpha_scale", alpha_scale(base).withColumns(zero)),
        ("candidate_filter", prepare_snapshot(filtered.drop("alpha_score")).withColumns(zero)),
        ("objective_penalty", base.withColumns({**zero, "gamma": F.lit(0.1)})),
        ("uncertainty_risk", risk.half_width_variance(base, shrink).withColumns({"gamma": F.lit(0.0)})),
        ("sign_adaptive", prepare_snapshot(signed).withColumns(zero)),
    ]
    return union_labelled(parts, "scheme")


def compare_schemes(panel: DataFrame, pred: DataFrame, robust_score: Column | str, limits: risk.Limits = risk.Limits(), min_candidates: int = 30) -> Backtest:
    """Baseline, the four weighting schemes, the sign tilt, the robust leg and the trust-gated blend."""
    codes = stage(pred.select(F.col("trade_date").alias("rebalance_date"), "ts_code"))
    windows = risk.return_windows(codes, panel, limits.covariance_window)
    shrink = risk.shrinkage(windows, codes, limits.covariance_window)
    schemes = scheme_snapshots(panel, pred, shrink, min_candidates)
    robust = panel.withColumn("score", F.col(robust_score) if isinstance(robust_score, str) else robust_score)
    robust = robust.select("trade_date", "ts_code", "industry_name", "benchmark_weight", "score")
    robust = robust.join(F.broadcast(pred.select("trade_date").distinct()), "trade_date", "left_semi").withColumnRenamed("trade_date", "rebalance_date")
    robust = prepare_snapshot(robust).withColumns({"gamma": F.lit(0.0), "extra_variance": F.lit(0.0)}).withColumn("scheme", F.lit("factor_robust_optimizer"))
    prepared = stage(schemes.unionByName(robust, allowMissingColumns=True).withColumn("confidence", F.coalesce("confidence", F.lit(0.5))))
    positions = stage(tilted_positions(prepared, panel, limits, ["scheme"]))
    trust = stage(trust_gate(pred, trading_calendar(panel), pred.select("trade_date").distinct()))
    leg = lambda s: positions.where(F.col("scheme") == s)
    gated = no_risk(blend(leg("conformal_ml_baseline"), leg("factor_robust_optimizer"), trust)).withColumn("scheme", F.lit("trust_gated"))
    return from_positions(panel, positions.unionByName(gated, allowMissingColumns=True), ["scheme"])


def seed_schemes(
    panel: DataFrame, features: Sequence[str], split_key, robust_score: str, seeds: Sequence[int] = SEEDS, limits: risk.Limits = risk.Limits(), **conformal
) -> Backtest:
    """Three schemes under several calibration seeds, labelled by ``seed`` and ``scheme``.

    ``baseline`` tilts by the model score, ``uncertainty_risk`` adds the half widths to the
    risk, ``trust_gated`` blends the baseline with the robust leg by each seed's realised
    coverage. Seeds and schemes are scenario columns of one tilt and one path; the robust leg,
    which no seed changes, is computed once. ``panel`` needs benchmark_weight and industry_name.
    """
    parts = [(s, conformal_predictions(panel, features, split_key=split_key(s), **conformal).predictions) for s in seeds]
    preds = stage(union_labelled(parts, "seed"))
    about = panel.select("trade_date", "ts_code", "industry_name", "benchmark_weight")
    rows = preds.select("seed", "trade_date", "ts_code", "ml_score", "ci_half_width", "confidence").join(about, ["trade_date", "ts_code"])
    rows = rows.withColumnRenamed("trade_date", "rebalance_date").withColumn("score", F.col("ml_score"))
    base = stage(prepare_confidence(prepare_snapshot(rows, by=["seed"]), by=["seed"]))
    codes = stage(base.select("rebalance_date", "ts_code").distinct())
    shrink = risk.shrinkage(risk.return_windows(codes, panel, limits.covariance_window), codes, limits.covariance_window)
    schemes = [("baseline", base.withColumn("extra_variance", F.lit(0.0))), ("uncertainty_risk", risk.half_width_variance(base, shrink, by=["seed"]))]
    positions = stage(tilted_positions(stage(union_labelled(schemes, "scheme")), panel, limits, ["seed", "scheme"]))
    robust = panel.withColumn("score", F.col(robust_score)).join(preds.select("trade_date").distinct(), "trade_date", "left_semi")
    robust = robust.select(F.col("trade_date").alias("rebalance_date"), "ts_code", "industry_name", "benchmark_weight", "score")
    leg = stage(tilted_positions(stage(prepare_snapshot(robust)), panel, limits))
    gated = []
    for s in seeds:
        own = preds.where(F.col("seed") == s)
        trust = stage(trust_gate(own, trading_calendar(panel), own.select("trade_date").distinct()))
        gated.append((s, blend(positions.where((F.col("seed") == s) & (F.col("scheme") == "baseline")), leg, trust)))
    gated = no_risk(union_labelled(gated, "seed")).withColumn("scheme", F.lit("trust_gated"))
    return from_positions(panel, positions.unionByName(gated, allowMissingColumns=True), ["seed", "scheme"])


def seed_scheme_table(metrics: DataFrame, metric: str = "information_ratio", baseline: str = "baseline") -> DataFrame:
    """Mean, deviation, range of a metric over the seeds of each scheme, and in how many seeds it beats the baseline."""
    base = metrics.where(F.col("scheme") == baseline).select("seed", F.col(metric).alias("_base"))
    rows = metrics.select("seed", "scheme", metric).join(base, "seed")
    return rows.groupBy("scheme").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"),
        F.count(F.lit(1)).alias("seeds"), F.sum((F.col(metric) > F.col("_base")).cast("long")).alias("wins"),
    )


def with_delta(table: DataFrame, label: str, baseline: str, metric: str = "information_ratio") -> DataFrame:
    """Add the difference of a metric to the baseline row's."""
    base = table.where(F.col(label) == baseline).agg(F.max(metric)).scalar()
    return table.withColumn(f"{metric}_delta", F.col(metric) - base)


def summary_table(runs: Sequence[tuple[str, Backtest]], label: str = "strategy", start: str | None = None, end: str | None = None) -> DataFrame:
    """Six headline metrics per named run, optionally on a test window."""
    cut = [(n, b.window(start, end) if start else b) for n, b in runs]
    return union_labelled([(n, b.metrics.select(*SUMMARY)) for n, b in cut], label)


def configurations(
    panel: DataFrame, features: Sequence[str], external: Sequence[str], baseline: str, train_months: int = 12, min_train_rows: int = 2000, embargo: int = 20
) -> DataFrame:
    """Scores of four configurations on rebalance dates, labelled by ``config``: the ``baseline`` column, the model on
    windows that run up to the day before, the embargoed model, and that one with the external series."""
    leaking, clean = rolling_plan(panel, train_months), rolling_plan(panel, train_months, embargo)
    plain = ols_variants(panel, leaking, {"model": features}, min_train_rows=min_train_rows).predictions
    strict = ols_variants(panel, clean, {"model_embargoed": features, "model_external": [*features, *external]}, min_train_rows=min_train_rows).predictions
    scores = plain.unionByName(strict).select(F.col("variant").alias("config"), F.col("trade_date").alias("rebalance_date"), "ts_code", F.round("ml_score", 8).alias("score"))
    base = snapshots(panel, baseline).select(F.lit("baseline").alias("config"), "rebalance_date", "ts_code", F.col(baseline).alias("score"))
    return base.unionByName(scores)


def configuration_table(panel: DataFrame, scores: DataFrame, returns: DataFrame, limits: risk.Limits = risk.Limits()) -> DataFrame:
    """Headline metrics and final NAV of every configuration of ``scores``, all sent through the constrained tilt in one plan.

    ``panel`` needs benchmark_weight and industry_name.
    """
    about = panel.select(F.col("trade_date").alias("rebalance_date"), "ts_code", "industry_name", "benchmark_weight")
    prepared = stage(prepare_snapshot(scores.join(about, ["rebalance_date", "ts_code"]), by=["config"]))
    run = from_positions(returns, tilted_positions(prepared, returns, limits, ["config"]), ["config"])
    last = run.nav.groupBy("config").agg(F.max_by("portfolio_nav", "trade_date").alias("final_nav"))
    return run.metrics.join(last, "config").select("config", "information_ratio", "annual_excess_return", "max_drawdown", "tracking_error", "annual_turnover", "final_nav")


def construction_comparison(optimised: DataFrame, equal: DataFrame) -> DataFrame:
    """Variant summaries of both portfolio constructions, stacked."""
    return union_labelled([("constrained_optimizer", optimised), ("rank_equal_weight", equal)], "portfolio_construction")


def variant_snapshots(panel: DataFrame, variants: Mapping[str, Sequence[str]]) -> DataFrame:
    """Optimiser snapshots of every feature variant under ``variant``. ``panel`` needs benchmark_weight and industry_name."""
    about = panel.select(F.col("trade_date").alias("rebalance_date"), "ts_code", "industry_name", "benchmark_weight")
    return prepare_snapshot(ablation_scores(panel, variants).join(about, ["rebalance_date", "ts_code"]), by=["variant"])


def variant_constructions(panel: DataFrame, returns: DataFrame, variants: Mapping[str, Sequence[str]], limits: risk.Limits = risk.Limits(), n: int = 20) -> DataFrame:
    """Metrics of every feature variant as an optimised and as an equal-weight book."""
    positions = tilted_positions(stage(variant_snapshots(panel, variants)), returns, limits, ["variant"])
    equal = feature_ablation(panel, variants, n).metrics.drop("feature_count", "feature_columns")
    return construction_comparison(from_positions(returns, positions, ["variant"]).metrics.select(equal.columns), equal)


def regime_metrics(nav: DataFrame, positions: DataFrame, regimes: Mapping[str, tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Metrics per named date range and strategy: rows are tagged by range, so all ranges are one plan."""
    spans = F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(a).cast("date").alias("_a"), F.lit(b).cast("date").alias("_b")) for n, (a, b) in regimes.items()])
    tag = lambda df, d: df.select("*", F.inline(spans)).where(F.col(d).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    keys = ["regime", *by]
    first = min(a for a, _ in regimes.values())
    return performance_metrics(slice_nav(tag(nav, "trade_date"), first, None, keys), tag(positions, "rebalance_date"), keys)


def regime_table(metrics: DataFrame, strategies: Sequence[str], value: str = "annual_excess_return", label: str = "strategy") -> DataFrame:
    return pivot_metric(metrics, "regime", label, value, strategies)


def horizon_table(groups: Sequence[tuple[str, DataFrame]], metric: str, label: str = "strategy") -> DataFrame:
    """One metric of every strategy, one column per sample (long horizon, out of sample, ...)."""
    return pivot_metric(union_labelled(groups, "sample"), label, "sample", metric, [n for n, _ in groups])

