"""Training windows, estimators, conformal intervals and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators.calendar import period_ends, trading_calendar
from alphaloom.operators.conformal import (
    bucket_order,
    calibrate,
    calibration_split,
    confidence_buckets,
    conformal_predictions,
    conformal_quantiles,
    coverage_by_alpha,
    coverage_report,
    group_quantiles,
    realised_correlation,
    sign_tilt,
    trust_gate,
)
from alphaloom.operators.training import (
    LABEL,
    boosted_alpha,
    frozen_plan,
    ols_alpha,
    rolling_plan,
    training_rows,
)
from checks import views as v
from checks.fixtures import EMBARGO, FEATURES, MIN_ROWS, TRAIN_MONTHS, r, rounded, split_key
from checks.registry import query

X = ["ret_20"]


def embargoed(d):
    return rolling_plan(d.model(), TRAIN_MONTHS, EMBARGO)


def fitted(d, adaptive=True):
    return calibrate(d.model(), embargoed(d), X, LABEL, split_key(), 0.3, MIN_ROWS, adaptive)


@query("mod01_month_ends", "SELECT trade_date FROM v_ends")
def mod01(d):
    return period_ends(d.model()).select("trade_date")


@query("mod01_quarter_ends", "SELECT MAX(trade_date) AS trade_date FROM v_cal GROUP BY DATE_TRUNC('quarter', trade_date)")
def mod01b(d):
    return period_ends(d.model(), "quarter").select("trade_date")


COUNT = f"""SELECT w.window_id, w.train_start, MAX(c.trade_date) AS train_last, COUNT(*) AS n_rows
FROM v_model m JOIN v_cal c ON m.trade_date = c.trade_date JOIN {{w}} w ON c.idx BETWEEN w.first_idx AND w.last_idx
WHERE m.{v.LABEL} IS NOT NULL GROUP BY ALL"""


def window_counts(d, plan):
    rows = training_rows(d.model(), plan).groupBy("window_id").agg(F.max("trade_date").alias("train_last"), F.count(F.lit(1)).alias("n_rows"))
    return rows.join(plan.bounds.select("window_id", "train_start"), "window_id")


@query("mod02_rolling_windows", COUNT.format(w="v_roll"))
def mod02(d):
    return window_counts(d, rolling_plan(d.model(), TRAIN_MONTHS))


@query("mod03_embargoed_windows", COUNT.format(w="v_win"))
def mod03(d):
    return window_counts(d, embargoed(d))


v.V["v_frows"] = f"SELECT 1 AS window_id, COALESCE(ret_20, 0) AS x, {v.LABEL} AS y FROM v_model WHERE trade_date <= DATE '1998-12-31' AND {v.LABEL} IS NOT NULL"
v.V["v_fcoef"] = v.ols("v_frows")


@query("mod04_frozen_ols", f"""SELECT m.trade_date, m.ts_code, ROUND(intercept + slope * COALESCE(ret_20, 0), 6) + 0.0 AS ml_score FROM v_model m CROSS JOIN v_fcoef
WHERE trade_date IN (SELECT MAX(trade_date) FROM v_cal WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY DATE_TRUNC('month', trade_date))""")
def mod04(d):
    plan = frozen_plan(d.model(), "1998-12-31", "1999-01-01", "2000-12-31")
    return rounded(ols_alpha(d.model(), plan, X, min_train_rows=MIN_ROWS).predictions.select("trade_date", "ts_code", "ml_score"), ["ml_score"])


@query("mod04_frozen_boosted")
def mod04b(d):
    plan = frozen_plan(d.model(), "1998-12-31", "1999-01-01")
    return boosted_alpha(d.model(), plan, FEATURES, min_train_rows=MIN_ROWS).predictions


v.V["v_zrows"] = f"""SELECT DATE '1998-12-31' AS window_id, trade_date, ts_code, industry_name, COALESCE(ret_20, 0) AS x, {v.LABEL} AS y
FROM v_model WHERE trade_date <= DATE '1998-12-31' AND {v.LABEL} IS NOT NULL"""
v.V["v_zsplit"] = v.split("v_zrows")
v.V["v_zcoef"] = v.ols("v_zsplit", where="NOT is_calibration")
v.V["v_zq"] = v.conf_q("(SELECT s.*, ABS(y - intercept - slope * x) AS score FROM v_zsplit s JOIN v_zcoef USING (window_id) WHERE is_calibration)", 0.1)


@query("mod04_frozen_conformal", """SELECT m.trade_date, m.ts_code, ROUND(intercept + slope * COALESCE(ret_20, 0), 6) + 0.0 AS ml_score, ROUND(q, 6) + 0.0 AS ci_half_width FROM v_model m CROSS JOIN v_zcoef CROSS JOIN v_zq
WHERE trade_date IN (SELECT MAX(trade_date) FROM v_cal WHERE trade_date >= DATE '1999-01-01' GROUP BY DATE_TRUNC('month', trade_date))""")
def mod04c(d):
    plan = frozen_plan(d.model(), "1998-12-31", "1999-01-01")
    res = conformal_predictions(d.model(), X, min_train_rows=MIN_ROWS, locally_adaptive=False, split_key=split_key(), plan=plan)
    return rounded(res.predictions.select("trade_date", "ts_code", "ml_score", "ci_half_width"), ["ml_score", "ci_half_width"])


@query("mod04_frozen_conformal_all_features")
def mod04d(d):
    plan = frozen_plan(d.model(), "1998-12-31", "1999-01-01")
    return conformal_predictions(d.model(), FEATURES, min_train_rows=MIN_ROWS, locally_adaptive=False, split_key=split_key(), plan=plan).predictions


v.V["v_ocoef"] = v.ols("v_wrows")


@query("mod05_rolling_ols", f"SELECT m.trade_date, m.ts_code, {v.rnd(v.LABEL)}, ROUND(intercept + slope * COALESCE(ret_20, 0), 6) + 0.0 AS ml_score FROM v_model m JOIN v_ocoef ON m.trade_date = window_id")
def mod05(d):
    return rounded(ols_alpha(d.model(), embargoed(d), X, min_train_rows=MIN_ROWS).predictions, [LABEL, "ml_score"])


@query("mod05_rolling_ols_three_features")
def mod05c(d):
    return ols_alpha(d.model(), embargoed(d), ["ret_20", "volatility_20", "turnover_20"], min_train_rows=MIN_ROWS).predictions


def mod05b(d):
    """Monthly windows at the default settings. Not registered: 300 rounds of some 70 windows take over an hour (README)."""
    return boosted_alpha(d.model(), embargoed(d), FEATURES, min_train_rows=MIN_ROWS).predictions


@query("mod06_calibration_split", "SELECT window_id, is_calibration, COUNT(*) AS n, MIN(trade_date) AS first_day, MAX(trade_date) AS last_day, CAST(SUM(ts_code) AS BIGINT) AS codes FROM v_split GROUP BY ALL")
def mod06(d):
    rows = calibration_split(training_rows(d.model(), embargoed(d)), split_key())
    n = rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("all_rows")).where(F.col("all_rows") >= MIN_ROWS)
    out = rows.groupBy("window_id", "is_calibration").agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.sum("ts_code").alias("codes")
    )
    return out.join(n, "window_id", "left_semi")


@query("mod06_adaptive_scores", "SELECT window_id, trade_date, ts_code, ROUND(score, 6) + 0.0 AS score FROM v_cscore")
def mod06b(d):
    return rounded(fitted(d).scores.select("window_id", "trade_date", "ts_code", "score"), ["score"])


v.V["v_abs"] = "SELECT *, res AS score FROM v_resid WHERE is_calibration"


@query("mod07_conformal_quantile", "SELECT window_id, n_calib, ROUND(q, 6) + 0.0 AS q FROM (" + v.conf_q("v_abs", 0.1) + ")")
def mod07(d):
    q = conformal_quantiles(fitted(d, False).scores, "score", [0.1])
    return q.select("window_id", "n_calib", r("q0").alias("q"))


@query("mod07_textbook_quantile", "SELECT window_id, n_calib, ROUND(q, 6) + 0.0 AS q FROM (" + v.conf_q("v_abs", 0.1, textbook=True) + ")")
def mod07b(d):
    q = conformal_quantiles(fitted(d, False).scores, "score", [0.1], textbook=True)
    return q.select("window_id", "n_calib", r("q0").alias("q"))


v.V["v_gq"] = v.conf_q("(SELECT * FROM v_cscore WHERE industry_name IS NOT NULL)", 0.1, "window_id, industry_name")


@query("mod08_group_quantile", "SELECT window_id, industry_name, n_calib, ROUND(q, 6) + 0.0 AS q FROM v_gq WHERE n_calib >= 5")
def mod08(d):
    q = group_quantiles(fitted(d).scores, "score", "industry_name", [0.1])
    return q.select("window_id", "industry_name", "n_calib", r("q0").alias("q"))


CONF = ("ml_score", "ci_lower", "ci_upper", "ci_half_width")


@query("mod09_intervals", f"SELECT trade_date, ts_code, {v.rnd(*CONF)} FROM v_conf")
def mod09(d):
    return rounded(d.conformal().select("trade_date", "ts_code", *CONF), CONF)


@query("mod09_intervals_all_features")
def mod09b(d):
    res = conformal_predictions(d.model(), FEATURES, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, split_key=split_key())
    return res.predictions.select("trade_date", "ts_code", *CONF, "confidence")


@query("mod10_confidence", f"SELECT trade_date, ts_code, {v.rnd('confidence')} FROM v_conf")
def mod10(d):
    return rounded(d.conformal().select("trade_date", "ts_code", "confidence"), ["confidence"])


@query("mod11_conformal_diagnostics", "SELECT q.window_id AS trade_date, CAST(0.1 AS DOUBLE) AS alpha, ROUND(q, 6) + 0.0 AS quantile, n_calib, TRUE AS locally_adaptive, TRUE AS mondrian, n_groups FROM v_q10 q JOIN (SELECT window_id, COUNT(DISTINCT industry_name) AS n_groups FROM v_cscore WHERE industry_name IS NOT NULL GROUP BY 1) USING (window_id)")
def mod11(d):
    res = conformal_predictions(d.model(), X, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, group="industry_name", split_key=split_key())
    return rounded(res.diagnostics, ["quantile"])


@query("mod11_mondrian_intervals", f"""SELECT m.trade_date, m.ts_code, ROUND(COALESCE(CASE WHEN g.n_calib >= 5 THEN g.q END, q.q) * (EXP(s.intercept + s.slope * COALESCE(m.ret_20, 0)) + 1e-6), 6) + 0.0 AS ci_half_width
FROM v_model m JOIN v_sigma s ON m.trade_date = s.window_id JOIN v_q10 q ON q.window_id = s.window_id
LEFT JOIN v_gq g ON g.window_id = s.window_id AND g.industry_name = m.industry_name""")
def mod11b(d):
    res = conformal_predictions(d.model(), X, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, group="industry_name", split_key=split_key())
    return rounded(res.predictions.select("trade_date", "ts_code", "ci_half_width"), ["ci_half_width"])


v.V["v_cov"] = f"SELECT *, CAST({v.LABEL} BETWEEN ci_lower AND ci_upper AS INT) AS hit FROM v_conf WHERE {v.LABEL} IS NOT NULL"
REPORT = """SELECT 'overall' AS scope, 'all' AS bucket, {c} FROM v_cov UNION ALL SELECT 'month', STRFTIME(trade_date, '%Y-%m'), {c} FROM v_cov GROUP BY 2
UNION ALL SELECT 'industry', industry_name, {c} FROM v_cov WHERE industry_name IS NOT NULL GROUP BY 2"""


@query("mod12_coverage_report", REPORT.format(c="ROUND(AVG(hit), 6) AS coverage, ROUND(AVG(ci_half_width), 6) AS avg_half_width, COUNT(*) AS n"))
def mod12(d):
    pred = d.conformal().join(d.industry().select("ts_code", "industry_name"), "ts_code", "left")
    return rounded(coverage_report(pred), ["coverage", "avg_half_width"])


ALPHAS = (0.05, 0.1, 0.2)
for i, a in enumerate(ALPHAS):
    v.V[f"v_qa{i}"] = v.conf_q("v_cscore", a)
    v.V[f"v_conf{i}"] = v.conformal(f"v_qa{i}")


@query("mod13_coverage_by_alpha", " UNION ALL ".join(
    f"SELECT CAST({a} AS DOUBLE) AS alpha, ROUND(1 - CAST({a} AS DOUBLE), 6) AS target_coverage, ROUND(AVG(h), 6) AS empirical_coverage, ROUND((AVG(h) - (1 - CAST({a} AS DOUBLE))) * 100, 5) + 0.0 AS deviation_pp, COUNT(*) AS n FROM (SELECT CAST({v.LABEL} BETWEEN ci_lower AND ci_upper AS INT) AS h FROM v_conf{i} WHERE {v.LABEL} IS NOT NULL)"
    for i, a in enumerate(ALPHAS)))
def mod13(d):
    res = conformal_predictions(d.model(), X, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, alphas=ALPHAS, split_key=split_key())
    return rounded(rounded(coverage_by_alpha(res.predictions), ["target_coverage", "empirical_coverage"]), ["deviation_pp"], 5)


BUCKETS = f"""SELECT bucket, COUNT(*) AS n, ROUND(AVG({v.LABEL}), 6) + 0.0 AS mean_label, ROUND(AVG(ml_score), 6) + 0.0 AS mean_score,
  ROUND(AVG({v.LABEL}) / NULLIF(STDDEV_POP({v.LABEL}), 0) * SQRT(252.0 / 20.0), 6) + 0.0 AS ir, ROUND(AVG(CAST({v.LABEL} > 0 AS INT)), 6) AS hit_rate
FROM (SELECT *, CASE WHEN confidence <= (SELECT QUANTILE_CONT(confidence, 0.3) FROM v_cov) THEN 'bottom_30'
        WHEN confidence >= (SELECT QUANTILE_CONT(confidence, 0.7) FROM v_cov) THEN 'top_30' ELSE 'mid_40' END AS bucket FROM v_cov) GROUP BY bucket"""


@query("mod14_confidence_buckets", BUCKETS)
def mod14(d):
    return rounded(confidence_buckets(d.conformal()), ["mean_label", "mean_score", "ir", "hit_rate"])


v.V["v_real"] = f"SELECT p.*, f.trade_date AS realized_date FROM v_cov p JOIN v_cal c ON p.trade_date = c.trade_date JOIN v_cal f ON f.idx = c.idx + 20"
v.V["v_trust"] = """SELECT e.trade_date AS rebalance_date, n AS n_realized, CASE WHEN n >= 50 THEN h / n END AS coverage,
  CASE WHEN n >= 50 THEN GREATEST(LEAST((h / n - 0.5) / (0.9 - 0.5), 1), 0) ELSE 0.5 END AS trust
FROM (SELECT e.trade_date, COUNT(r.hit) AS n, CAST(SUM(r.hit) AS DOUBLE) AS h FROM v_ends e LEFT JOIN v_real r ON r.realized_date <= e.trade_date GROUP BY 1) e"""


@query("mod15_trust_gate", f"SELECT rebalance_date, n_realized, {v.rnd('coverage', 'trust')} FROM v_trust")
def mod15(d):
    out = trust_gate(d.conformal(), trading_calendar(d.model()), period_ends(d.model()))
    return rounded(out, ["coverage", "trust"])


@query("mod16_importance_summary", "SELECT 'ret_20' AS feature, ROUND(AVG(ABS(slope)), 6) AS mean, ROUND(COALESCE(STDDEV_SAMP(ABS(slope)), 0), 6) AS std FROM v_ocoef")
def mod16(d):
    from alphaloom.operators.reports import importance_summary

    imp = ols_alpha(d.model(), embargoed(d), X, min_train_rows=MIN_ROWS).importance
    return rounded(importance_summary(imp), ["mean", "std"])


@query("mod16_importance_summary_all_features")
def mod16b(d):
    from alphaloom.operators.reports import importance_summary

    return importance_summary(ols_alpha(d.model(), embargoed(d), FEATURES, min_train_rows=MIN_ROWS).importance)


v.V["v_corr"] = f"""SELECT e.trade_date, CASE WHEN COUNT(r.hit) >= 200 AND STDDEV_POP(r.confidence) > 0 THEN COALESCE(CORR(r.confidence, r.{v.LABEL}), 0) ELSE 0 END AS r
FROM (SELECT DISTINCT trade_date FROM v_conf) e LEFT JOIN v_real r ON r.realized_date <= e.trade_date GROUP BY 1"""
v.V["v_tilted"] = """SELECT c.trade_date, ts_code,
  COALESCE((ml_score - AVG(ml_score) OVER g) / NULLIF(STDDEV_POP(ml_score) OVER g, 0), 0) + r.r * COALESCE((confidence - AVG(confidence) OVER g) / NULLIF(STDDEV_POP(confidence) OVER g, 0), 0) AS score
FROM v_conf c JOIN v_corr r ON r.trade_date = c.trade_date WINDOW g AS (PARTITION BY c.trade_date)"""


@query("fac09_sign_tilt", f"SELECT trade_date, ts_code, {v.rnd('score', digits=5)} FROM v_tilted")
def fac09(d):
    c = realised_correlation(d.conformal(), trading_calendar(d.model()), d.conformal().select("trade_date").distinct())
    return rounded(sign_tilt(d.conformal(), c).select("trade_date", "ts_code", "score"), ["score"], 5)
