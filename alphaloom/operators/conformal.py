"""Split and group-wise conformal intervals on rolling, embargoed or frozen windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.calendar import as_of_calendar, shift_dates
from alphaloom.operators.cross_section import min_max_unit, zscore
from alphaloom.operators.learners import EPS, Learner, LeastSquares, Model, Target
from alphaloom.operators.order_stats import OrderStat, grouped_order_stats
from alphaloom.operators.split import split_windows
from alphaloom.operators.staging import stage
from alphaloom.operators.training import LABEL, TrainingPlan, rolling_plan, target_rows
from alphaloom.schemas import require_columns

ANNUAL_20D = (252.0 / 20.0) ** 0.5


@dataclass(frozen=True)
class ConformalResult:
    """``predictions`` in the conformal layout (plus ``alpha`` when several were asked for) and
    one ``diagnostics`` row per scored date."""

    predictions: DataFrame
    diagnostics: DataFrame
    importance: DataFrame


def conformal_rank(alpha: float, textbook: bool = False) -> Callable[[Column], Column]:
    """Rank of the finite-sample quantile among n calibration scores.

    With ``k = min(ceil((n+1)(1-alpha)), n)`` the reference's "higher" quantile at level k/n is
    the (k+1)-th smallest score, capped at n; ``textbook`` uses the k-th.
    """

    def rank(n: Column) -> Column:
        k = F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)), n)
        return k if textbook else F.least(k + 1, n)

    return rank


def default_split_key(seed: int = 42) -> Column:
    """Random-looking order of the training rows for the calibration split (53 bits, exact as a double)."""
    return F.pmod(F.xxhash64("ts_code", "trade_date", F.lit(seed)), F.lit(1 << 53))


def calibration_split(rows: DataFrame, key: Column, ratio: float = 0.3, windows: Sequence[str] = ("window_id",)) -> DataFrame:
    """Mark the ``ceil(ratio·n)`` rows of each window with the smallest split keys as ``is_calibration``."""
    keyed = rows.withColumn("_key", key.cast("double"))
    cut = grouped_order_stats(
        keyed, windows, {"_cut": OrderStat(F.col("_key"), ratio, lambda n: F.ceil(n * F.lit(ratio)))}
    ).select(*windows, "_cut")
    return keyed.join(stage(cut), list(windows)).withColumn("is_calibration", F.col("_key") <= F.col("_cut")).drop("_key", "_cut")


def conformal_quantiles(
    scores: DataFrame, score: str, alphas: Sequence[float], keys: Sequence[str] = ("window_id",), textbook: bool = False, calendar_keyed: bool = True
) -> DataFrame:
    """Finite-sample quantile of calibration scores per key, one column ``q<i>`` per alpha, and ``n_calib``."""
    stats = {f"q{i}": OrderStat(F.col(score), 1.0 - a, conformal_rank(a, textbook)) for i, a in enumerate(alphas)}
    out = grouped_order_stats(scores, keys, stats)
    return stage(out.select(*keys, *stats, F.col("q0_n").alias("n_calib")))


def group_quantiles(scores: DataFrame, score: str, group: str, alphas: Sequence[float], min_group: int = 5) -> DataFrame:
    """Per (window, group) quantiles for groups with enough calibration rows."""
    q = conformal_quantiles(scores.where(F.col(group).isNotNull()), score, alphas, ("window_id", group), calendar_keyed=False)
    return q.where(F.col("n_calib") >= min_group)


@dataclass(frozen=True)
class Calibrated:
    """Fitted models of one calibration and its scored calibration rows (``score``)."""

    base: Model
    sigma: Model | None
    scores: DataFrame


def calibrate(
    panel: DataFrame,
    plan: TrainingPlan,
    features: Sequence[str],
    label: str,
    split_key: Column,
    ratio: float,
    min_train_rows: int,
    locally_adaptive: bool,
    base: Learner | None = None,
    sigma: Learner | None = None,
    keep: Sequence[str] = ("trade_date", "ts_code", "industry_name"),
) -> Calibrated:
    """Fit ``base`` (and ``sigma`` on its log residuals) on the proper part of each window and score its calibration part.

    Both default to least squares. Only calibration rows are laid out once per window; they
    are staged with the columns ``keep``.
    """
    windows = split_windows(panel, plan.windows, label, split_key, ratio, max(4, min_train_rows))
    fitted = (base or LeastSquares()).fit(windows, features, Target(label))
    spread = (sigma or LeastSquares()).fit(windows, features, Target(label, fitted)) if locally_adaptive else None
    rows = fitted.predict(windows.calibration(), "_fitted")
    residual = F.abs(F.col(label) - F.col("_fitted"))
    if spread is not None:
        rows = spread.predict(rows, "_log_sigma")
        residual = residual / (F.exp("_log_sigma") + EPS)
    columns = ["window_id", *[c for c in keep if c in panel.columns]]
    return Calibrated(fitted, spread, stage(rows.select(*columns, residual.alias("score"))))


def conformal_predictions(
    panel: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    train_months: int = 12,
    min_train_rows: int = 2000,
    embargo: int | None = 20,
    alphas: Sequence[float] = (0.1,),
    ratio: float = 0.3,
    locally_adaptive: bool = True,
    group: str | None = None,
    split_key: Column | None = None,
    plan: TrainingPlan | None = None,
    textbook: bool = False,
    base: Learner | None = None,
    sigma: Learner | None = None,
) -> ConformalResult:
    """Calibrated intervals and confidence for every scored date, with any learners (:mod:`alphaloom.operators.learners`).

    All windows and all alphas run in one plan. With ``group`` the quantile is the group's own
    where it has at least five calibration rows, else the window's.
    """
    require_columns(panel, ["trade_date", "ts_code", label, *features, *([group] if group else [])], "panel")
    plan = plan or rolling_plan(panel, train_months, embargo)
    fitted = calibrate(
        panel, plan, features, label, split_key if split_key is not None else default_split_key(), ratio, min_train_rows, locally_adaptive, base, sigma, [group] if group else []
    )
    span = range(len(alphas))
    q = conformal_quantiles(fitted.scores, "score", alphas, textbook=textbook)
    rows = fitted.base.predict(target_rows(panel, plan), "ml_score").join(q, "window_id")
    n_groups = F.lit(None).cast("long")
    diag = q
    if group is not None:
        own = group_quantiles(fitted.scores, "score", group, alphas)
        own_named = own.select("window_id", group, *[F.col(f"q{i}").alias(f"_own{i}") for i in span])
        rows = rows.join(own_named, ["window_id", group], "left")
        rows = rows.withColumns({f"q{i}": F.coalesce(f"_own{i}", f"q{i}") for i in span})
        groups = fitted.scores.where(F.col(group).isNotNull()).groupBy("window_id").agg(F.countDistinct(group).alias("n_groups"))
        diag = diag.join(groups, "window_id", "left")
        n_groups = F.col("n_groups")
    spread = F.lit(1.0)
    if fitted.sigma is not None:
        rows = fitted.sigma.predict(rows, "_log_sigma")
        spread = F.exp("_log_sigma") + EPS
    levels = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"q{i}").alias("_q")) for i, a in enumerate(alphas)])
    rows = rows.select("trade_date", "ts_code", label, "ml_score", spread.alias("_sigma"), F.inline(levels))
    half = F.col("_q") * F.col("_sigma")
    rows = rows.withColumns({"ci_lower": F.col("ml_score") - half, "ci_upper": F.col("ml_score") + half, "ci_half_width": half})
    rows = confidence(rows, ["alpha", "trade_date"] if len(alphas) > 1 else ["trade_date"])
    many = ["alpha"] if len(alphas) > 1 else []
    predictions = rows.select(*many, "trade_date", "ts_code", label, "ml_score", "ci_lower", "ci_upper", "ci_half_width", "confidence")
    diagnostics = plan.targets.join(diag, "window_id").select(
        "trade_date",
        F.inline(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"q{i}").alias("quantile")) for i, a in enumerate(alphas)])),
        "n_calib",
        n_groups.alias("n_groups"),
        F.lit(locally_adaptive).alias("locally_adaptive"),
        F.lit(group is not None).alias("mondrian"),
    )
    importance = plan.targets.join(fitted.base.importance(), "window_id").select("trade_date", "feature", "importance")
    return ConformalResult(predictions, diagnostics, importance)


def confidence(rows: DataFrame, keys: Sequence[str] = ("trade_date",)) -> DataFrame:
    """``1/(2·half width + 1e-6)`` scaled to [0, 1] per scored date."""
    raw = rows.withColumn("_raw", F.lit(1.0) / (2.0 * F.col("ci_half_width") + EPS))
    return min_max_unit(raw, "_raw", "confidence", keys, EPS).drop("_raw")


# --- reports ------------------------------------------------------------------------------


def valid_intervals(pred: DataFrame, label: str = LABEL) -> DataFrame:
    require_columns(pred, ["trade_date", "ts_code", label, "ci_lower", "ci_upper"], "predictions")
    rows = pred.where(F.col(label).isNotNull() & F.col("ci_lower").isNotNull() & F.col("ci_upper").isNotNull())
    return rows.withColumn("covered", F.col(label).between(F.col("ci_lower"), F.col("ci_upper")))


def coverage_report(pred: DataFrame, label: str = LABEL, industry: bool = True) -> DataFrame:
    """Coverage, mean half width and n: overall, per month and per industry, in one grouping-sets pass."""
    rows = valid_intervals(pred, label)
    if "ci_half_width" not in rows.columns:
        rows = rows.withColumn("ci_half_width", (F.col("ci_upper") - F.col("ci_lower")) / 2.0)
    rows = rows.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    by_industry = industry and "industry_name" in rows.columns
    if not by_industry:
        rows = rows.withColumn("industry_name", F.lit(None).cast("string"))
    sets = [[], [F.col("month")]] + ([[F.col("industry_name")]] if by_industry else [])
    out = rows.groupingSets(sets, "month", "industry_name").agg(
        F.grouping("month").alias("_gm"),
        F.grouping("industry_name").alias("_gi"),
        F.avg(F.col("covered").cast("int")).alias("coverage"),
        F.avg("ci_half_width").alias("avg_half_width"),
        F.count(F.lit(1)).alias("n"),
    )
    scope = F.when(F.col("_gm") == 0, "month").when(F.col("_gi") == 0, "industry").otherwise("overall")
    bucket = F.when(F.col("_gm") == 0, F.col("month")).when(F.col("_gi") == 0, F.col("industry_name")).otherwise("all")
    return out.select(scope.alias("scope"), bucket.alias("bucket"), "coverage", "avg_half_width", "n").where("bucket IS NOT NULL AND n > 0")


def coverage_by_alpha(pred: DataFrame, label: str = LABEL) -> DataFrame:
    """Target and empirical coverage and their gap in percentage points, per alpha."""
    rows = valid_intervals(pred, label)
    target = F.lit(1.0) - F.col("alpha")
    out = rows.groupBy("alpha").agg(F.avg(F.col("covered").cast("int")).alias("empirical_coverage"), F.count(F.lit(1)).alias("n"))
    return out.select("alpha", target.alias("target_coverage"), "empirical_coverage", ((F.col("empirical_coverage") - target) * 100.0).alias("deviation_pp"), "n")


def confidence_buckets(pred: DataFrame, label: str = LABEL, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """n, mean label, mean score, annualised IR and hit rate of the low, middle and high confidence buckets."""
    rows = pred.where(F.col(label).isNotNull() & F.col("confidence").isNotNull())
    cuts = stage(grouped_order_stats(rows, [], {"_lo": OrderStat(F.col("confidence"), low), "_hi": OrderStat(F.col("confidence"), high)}))
    lo, hi = cuts.select("_lo").scalar(), cuts.select("_hi").scalar()
    c = F.col("confidence")
    bucket = F.when(c <= lo, "bottom_30").when(c >= hi, "top_30").otherwise("mid_40")
    y = F.col(label)
    out = rows.withColumn("bucket", bucket).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean_label"),
        F.avg("ml_score").alias("mean_score"),
        F.stddev_pop(y).alias("_s"),
        F.avg((y > 0).cast("int")).alias("hit_rate"),
    )
    ir = F.when(F.col("_s") > 0, F.col("mean_label") / F.col("_s") * ANNUAL_20D)
    return out.select("bucket", "n", "mean_label", "mean_score", ir.alias("ir"), "hit_rate")


def bucket_order(bucket: Column) -> Column:
    return F.when(bucket == "top_30", 0).when(bucket == "mid_40", 1).otherwise(2)


# --- adaptive quantities from realised history ----------------------------------------------


def realised(pred: DataFrame, calendar: DataFrame, horizon: int = 20) -> DataFrame:
    """Add ``realized_date``: the day the forward label of a row is fully known (NULL past the end)."""
    return pred.join(F.broadcast(shift_dates(calendar, horizon, "realized_date").drop("idx")), "trade_date", "left")


def _history(known: DataFrame, sums: dict[str, Column], dates: DataFrame) -> DataFrame:
    """Cumulative sums over realised dates, taken as of each target date: n_dates rows, never rows x dates."""
    per_day = known.groupBy(F.col("realized_date").alias("trade_date")).agg(*[c.alias(n) for n, c in sums.items()])
    run = W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    per_day = per_day.select("trade_date", *[F.sum(n).over(run).alias(n) for n in sums])
    return as_of_calendar(dates, per_day)


def trust_gate(pred: DataFrame, calendar: DataFrame, dates: DataFrame, label: str = LABEL, horizon: int = 20, target: float = 0.9, floor: float = 0.5, warmup: float = 0.5, min_realised: int = 50) -> DataFrame:
    """Trust per rebalance date from the coverage of labels realised by then.

    ``trust = clip((coverage - floor)/(target - floor), 0, 1)``; ``warmup`` with fewer than
    ``min_realised`` rows.
    """
    known = realised(valid_intervals(pred, label), calendar, horizon).where("realized_date IS NOT NULL")
    hist = _history(known, {"n": F.count(F.lit(1)), "hits": F.sum(F.col("covered").cast("long"))}, dates.select("trade_date"))
    enough = F.coalesce(F.col("n"), F.lit(0)) >= min_realised
    cov = F.when(enough, F.col("hits") / F.col("n"))
    g = F.greatest(F.least((cov - floor) / F.lit(target - floor), F.lit(1.0)), F.lit(0.0))
    return hist.select(F.col("trade_date").alias("rebalance_date"), F.when(enough, g).otherwise(warmup).alias("trust"), cov.alias("coverage"), F.coalesce("n", F.lit(0)).alias("n_realized"))


def realised_correlation(pred: DataFrame, calendar: DataFrame, dates: DataFrame, label: str = LABEL, horizon: int = 20, min_realised: int = 200) -> DataFrame:
    """Expanding correlation of confidence and label over realised rows, as of each date; 0 when unusable.

    Days are added up from centred moments about a fixed point near the data (the means of all rows), so that a
    large mean takes no digits from the spread.
    """
    known = realised(pred, calendar, horizon).where(F.col("realized_date").isNotNull() & F.col(label).isNotNull() & F.col("confidence").isNotNull())
    centre = known.agg(F.avg("confidence"), F.avg(label)).first()
    x, y = F.col("confidence") - F.lit(centre[0] or 0.0), F.col(label) - F.lit(centre[1] or 0.0)
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x), "syy": F.sum(y * y)}
    hist = _history(known, sums, dates.select("trade_date"))
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return hist.select("trade_date", F.when((n >= min_realised) & (vx > 1e-12) & (vy > 1e-12), r).otherwise(0.0).alias("r"))


def sign_tilt(pred: DataFrame, correlation: DataFrame, strength: float = 1.0) -> DataFrame:
    """``score = z(ml_score) + strength·r_t·z(confidence)`` with population z-scores per date (no spread: 0)."""
    z = zscore(pred.withColumns({"_zm": F.col("ml_score"), "_zc": F.col("confidence")}), ["_zm", "_zc"], ddof=0, flat=0.0)
    out = z.join(F.broadcast(correlation.select("trade_date", "r")), "trade_date", "left")
    return out.withColumn("score", F.col("_zm") + strength * F.coalesce("r", F.lit(0.0)) * F.col("_zc")).drop("_zm", "_zc", "r")
