"""Model queries on all five features, with SQL by successive residuals.

Feature j is replaced by its residual q<j> on the ones before it (within a window's training rows); on such residuals
the coefficients of a regression are single covariances, so no system of equations is solved in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators.calendar import period_ends, trading_calendar
from alphaloom.operators.conformal import (
    calibrate,
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
from alphaloom.operators.learners import Forest
from alphaloom.operators.reports import importance_summary
from alphaloom.operators.training import LABEL, frozen_plan, ols_alpha, rolling_plan
from checks import views as v
from checks.fixtures import EMBARGO, FEATURES, MIN_ROWS, TRAIN_MONTHS, r, rounded, split_key
from checks.q_model import ALPHAS, CONF
from checks.registry import query

P = len(FEATURES)
SPAN = range(1, P + 1)
THREE = ("ret_20", "volatility_20", "turnover_20")


def rows_sql(features=FEATURES, source="v_model m JOIN v_cal c ON m.trade_date = c.trade_date JOIN v_win w ON c.idx BETWEEN w.first_idx AND w.last_idx", window="w.window_id", where="TRUE") -> str:
    x = ", ".join(f"COALESCE(m.{c}, 0) AS x{j}" for j, c in enumerate(features, 1))
    return f"""SELECT {window} AS window_id, m.trade_date, m.ts_code, m.industry_name, {x}, m.{v.LABEL} AS y FROM {source}
WHERE m.{v.LABEL} IS NOT NULL AND {where} QUALIFY COUNT(*) OVER (PARTITION BY {window}) >= {MIN_ROWS}"""


def residuals(name: str, rows: str, where: str, p: int = P) -> None:
    """Views ``<name>_q1..p`` (rows with residuals) and ``<name>_t`` (a row per window: means, slopes, coefficients on the residuals)."""
    before = rows
    for j in range(1, p + 1):
        slopes = "".join(f", CASE WHEN VAR_POP(q{k}) > 1e-12 * VAR_POP(x{k}) THEN COVAR_POP(x{j}, q{k}) / VAR_POP(q{k}) ELSE 0 END AS b{j}_{k}" for k in range(1, j))
        less = "".join(f" - b{j}_{k} * q{k}" for k in range(1, j))
        v.V[f"{name}_q{j}"] = f"SELECT *, x{j} - m{j}{less} AS q{j} FROM {before} JOIN (SELECT window_id, AVG(x{j}) AS m{j}{slopes} FROM {before} WHERE {where} GROUP BY 1) USING (window_id)"
        before = f"{name}_q{j}"
    kept = ", ".join(f"ANY_VALUE({c}) AS {c}" for j in range(1, p + 1) for c in (f"m{j}", *(f"b{j}_{k}" for k in range(1, j))))
    v.V[f"{name}_t"] = f"SELECT window_id, COUNT(*) AS n_train, AVG(y) AS my, {on_residuals('y', 't', p)}, {kept} FROM {before} WHERE {where} GROUP BY 1"


def on_residuals(y: str, out: str, p: int = P) -> str:
    return ", ".join(f"CASE WHEN VAR_POP(q{j}) > 1e-12 * VAR_POP(x{j}) THEN COVAR_POP({y}, q{j}) / VAR_POP(q{j}) ELSE 0 END AS {out}{j}" for j in range(1, p + 1))


def fitted(mean: str = "my", coef: str = "t", p: int = P) -> str:
    return mean + "".join(f" + {coef}{j} * q{j}" for j in range(1, p + 1))


def scored(name: str, source: str, on: str, features=FEATURES) -> str:
    """Rows of ``source`` with their residuals under the window ``on`` names."""
    p = len(features)
    out = f"SELECT m.*, t.* EXCLUDE (n_train), " + ", ".join(f"COALESCE(m.{c}, 0) AS x{j}" for j, c in enumerate(features, 1)) + f" FROM {source} m JOIN {name}_t t ON {on}"
    for j in range(1, p + 1):
        less = "".join(f" - b{j}_{k} * q{k}" for k in range(1, j))
        out = f"SELECT *, x{j} - m{j}{less} AS q{j} FROM ({out})"
    return out


def importance_sql(name: str, p: int = P, cap: int = P) -> str:
    """Slopes of the features themselves, from those of the residuals, last feature first."""
    out = f"{name}_t"
    for j in range(p, 0, -1):
        less = "".join(f" - b{i}_{j} * beta{i}" for i in range(j + 1, p + 1))
        out = f"(SELECT *, t{j}{less} AS beta{j} FROM {out})"
    return out


# rolling embargoed windows: all rows (plain OLS), and split into a proper and a calibration part
v.V["v_f5"] = rows_sql()
residuals("v_fo", "v_f5", "TRUE")
v.V["v_f5s"] = v.split("v_f5")
residuals("v_fc", "v_f5s", "NOT is_calibration")
v.V["v_fres"] = f"SELECT s.*, ABS(y - ({fitted()})) AS res FROM v_fc_q{P} s JOIN (SELECT window_id, my, {', '.join(f't{j}' for j in SPAN)} FROM v_fc_t) USING (window_id)"
v.V["v_fu"] = f"SELECT window_id, AVG(lr) AS mu, {on_residuals('lr', 'u')} FROM (SELECT *, LN(res + 1e-6) AS lr FROM v_fres) WHERE NOT is_calibration GROUP BY 1"
v.V["v_fscore"] = f"SELECT *, res / (EXP({fitted('mu', 'u')}) + 1e-6) AS score FROM v_fres JOIN v_fu USING (window_id) WHERE is_calibration"
v.V["v_fabs"] = "SELECT *, res AS score FROM v_fres WHERE is_calibration"
v.V["v_fq"] = v.conf_q("v_fscore", 0.1)
v.V["v_fgq"] = v.conf_q("(SELECT * FROM v_fscore WHERE industry_name IS NOT NULL)", 0.1, "window_id, industry_name")


def conformal_sql(q: str) -> str:
    return f"""
SELECT trade_date, ts_code, industry_name, {v.LABEL}, ml_score, ml_score - hw AS ci_lower, ml_score + hw AS ci_upper, hw AS ci_half_width,
  CASE WHEN MAX(raw) OVER d - MIN(raw) OVER d <= 1e-6 THEN 1.0 ELSE (raw - MIN(raw) OVER d) / (MAX(raw) OVER d - MIN(raw) OVER d + 1e-6) END AS confidence
FROM (SELECT *, 1 / (2 * hw + 1e-6) AS raw FROM (
  SELECT m.trade_date, m.ts_code, m.industry_name, m.{v.LABEL}, {fitted()} AS ml_score, q.q * (EXP({fitted('mu', 'u')}) + 1e-6) AS hw
  FROM ({scored('v_fc', 'v_model', 'm.trade_date = t.window_id')}) m JOIN v_fu u ON u.window_id = m.window_id JOIN {q} q ON q.window_id = m.window_id))
WINDOW d AS (PARTITION BY trade_date)"""


v.V["v_fconf"] = conformal_sql("v_fq")


def embargoed(d):
    return rolling_plan(d.model(), TRAIN_MONTHS, EMBARGO)


def run(d, **more):
    return conformal_predictions(d.model(), FEATURES, **{**dict(train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO, split_key=split_key()), **more})


def calibrated(d, adaptive=True):
    name = f"calibrated_five_{adaptive}"
    if name not in d._views:
        d._views[name] = calibrate(d.model(), embargoed(d), FEATURES, LABEL, split_key(), 0.3, MIN_ROWS, adaptive)
    return d._views[name]


@query("mod05_ols_all_features", f"SELECT trade_date, ts_code, {v.rnd(v.LABEL)}, ROUND({fitted()}, 6) + 0.0 AS ml_score FROM ({scored('v_fo', 'v_model', 'm.trade_date = t.window_id')})")
def mod05(d):
    return rounded(ols_alpha(d.model(), embargoed(d), FEATURES, min_train_rows=MIN_ROWS).predictions, [LABEL, "ml_score"])


@query("mod06_adaptive_scores_all_features", "SELECT window_id, trade_date, ts_code, ROUND(score, 6) + 0.0 AS score FROM v_fscore")
def mod06(d):
    return rounded(calibrated(d).scores.select("window_id", "trade_date", "ts_code", "score"), ["score"])


@query("mod07_conformal_quantile_all_features", "SELECT window_id, n_calib, ROUND(q, 6) + 0.0 AS q FROM (" + v.conf_q("v_fabs", 0.1) + ")")
def mod07(d):
    return conformal_quantiles(calibrated(d, False).scores, "score", [0.1]).select("window_id", "n_calib", r("q0").alias("q"))


@query("mod07_textbook_quantile_all_features", "SELECT window_id, n_calib, ROUND(q, 6) + 0.0 AS q FROM (" + v.conf_q("v_fabs", 0.1, textbook=True) + ")")
def mod07b(d):
    return conformal_quantiles(calibrated(d, False).scores, "score", [0.1], textbook=True).select("window_id", "n_calib", r("q0").alias("q"))


@query("mod08_group_quantile_all_features", "SELECT window_id, industry_name, n_calib, ROUND(q, 6) + 0.0 AS q FROM v_fgq WHERE n_calib >= 5")
def mod08(d):
    return group_quantiles(calibrated(d).scores, "score", "industry_name", [0.1]).select("window_id", "industry_name", "n_calib", r("q0").alias("q"))


@query("mod09_conformal_all_features", f"SELECT trade_date, ts_code, {v.rnd(*CONF)} FROM v_fconf")
def mod09(d):
    return rounded(d.conformal_five().select("trade_date", "ts_code", *CONF), CONF)


@query("mod10_confidence_all_features", f"SELECT trade_date, ts_code, {v.rnd('confidence')} FROM v_fconf")
def mod10(d):
    return rounded(d.conformal_five().select("trade_date", "ts_code", "confidence"), ["confidence"])


@query("mod11_conformal_diagnostics_all_features", "SELECT q.window_id AS trade_date, CAST(0.1 AS DOUBLE) AS alpha, ROUND(q, 6) + 0.0 AS quantile, n_calib, TRUE AS locally_adaptive, TRUE AS mondrian, n_groups FROM v_fq q JOIN (SELECT window_id, COUNT(DISTINCT industry_name) AS n_groups FROM v_fscore WHERE industry_name IS NOT NULL GROUP BY 1) USING (window_id)")
def mod11(d):
    return rounded(run(d, group="industry_name").diagnostics, ["quantile"])


@query("mod11_mondrian_intervals_all_features", f"""SELECT m.trade_date, m.ts_code, ROUND(COALESCE(CASE WHEN g.n_calib >= 5 THEN g.q END, q.q) * (EXP({fitted('mu', 'u')}) + 1e-6), 6) + 0.0 AS ci_half_width
FROM ({scored('v_fc', 'v_model', 'm.trade_date = t.window_id')}) m JOIN v_fu u ON u.window_id = m.window_id JOIN v_fq q ON q.window_id = m.window_id
LEFT JOIN v_fgq g ON g.window_id = m.window_id AND g.industry_name = m.industry_name""")
def mod11b(d):
    return rounded(run(d, group="industry_name").predictions.select("trade_date", "ts_code", "ci_half_width"), ["ci_half_width"])


@query("mod11_forest_intervals")
def mod11c(d):
    """Random forests as base and, shallower, as spread, on one frozen window: no SQL; the tests hold it against numpy and Spark ML."""
    forest, plan = Forest(), frozen_plan(d.model(), "1998-12-31", "1999-01-01")
    return run(d, base=forest, sigma=forest.shallower(), plan=plan).predictions


v.V["v_fcov"] = f"SELECT *, CAST({v.LABEL} BETWEEN ci_lower AND ci_upper AS INT) AS hit FROM v_fconf WHERE {v.LABEL} IS NOT NULL"
REPORT = """SELECT 'overall' AS scope, 'all' AS bucket, {c} FROM v_fcov UNION ALL SELECT 'month', STRFTIME(trade_date, '%Y-%m'), {c} FROM v_fcov GROUP BY 2
UNION ALL SELECT 'industry', industry_name, {c} FROM v_fcov WHERE industry_name IS NOT NULL GROUP BY 2"""


@query("mod12_coverage_report_all_features", REPORT.format(c="ROUND(AVG(hit), 6) AS coverage, ROUND(AVG(ci_half_width), 6) AS avg_half_width, COUNT(*) AS n"))
def mod12(d):
    pred = d.conformal_five().join(d.industry().select("ts_code", "industry_name"), "ts_code", "left")
    return rounded(coverage_report(pred), ["coverage", "avg_half_width"])


for i, a in enumerate(ALPHAS):
    v.V[f"v_fqa{i}"] = v.conf_q("v_fscore", a)
    v.V[f"v_fconf{i}"] = conformal_sql(f"v_fqa{i}")


@query("mod13_coverage_by_alpha_all_features", " UNION ALL ".join(
    f"SELECT CAST({a} AS DOUBLE) AS alpha, ROUND(1 - CAST({a} AS DOUBLE), 6) AS target_coverage, ROUND(AVG(h), 6) AS empirical_coverage, ROUND((AVG(h) - (1 - CAST({a} AS DOUBLE))) * 100, 5) + 0.0 AS deviation_pp, COUNT(*) AS n FROM (SELECT CAST({v.LABEL} BETWEEN ci_lower AND ci_upper AS INT) AS h FROM v_fconf{i} WHERE {v.LABEL} IS NOT NULL)"
    for i, a in enumerate(ALPHAS)))
def mod13(d):
    return rounded(rounded(coverage_by_alpha(run(d, alphas=ALPHAS).predictions), ["target_coverage", "empirical_coverage"]), ["deviation_pp"], 5)


BUCKETS = f"""SELECT bucket, COUNT(*) AS n, ROUND(AVG({v.LABEL}), 6) + 0.0 AS mean_label, ROUND(AVG(ml_score), 6) + 0.0 AS mean_score,
  ROUND(AVG({v.LABEL}) / NULLIF(STDDEV_POP({v.LABEL}), 0) * SQRT(252.0 / 20.0), 6) + 0.0 AS ir, ROUND(AVG(CAST({v.LABEL} > 0 AS INT)), 6) AS hit_rate
FROM (SELECT *, CASE WHEN confidence <= (SELECT QUANTILE_CONT(confidence, 0.3) FROM v_fcov) THEN 'bottom_30'
        WHEN confidence >= (SELECT QUANTILE_CONT(confidence, 0.7) FROM v_fcov) THEN 'top_30' ELSE 'mid_40' END AS bucket FROM v_fcov) GROUP BY bucket"""


@query("mod14_confidence_buckets_all_features", BUCKETS)
def mod14(d):
    return rounded(confidence_buckets(d.conformal_five()), ["mean_label", "mean_score", "ir", "hit_rate"])


v.V["v_freal"] = "SELECT p.*, f.trade_date AS realized_date FROM v_fcov p JOIN v_cal c ON p.trade_date = c.trade_date JOIN v_cal f ON f.idx = c.idx + 20"
v.V["v_ftrust"] = """SELECT e.trade_date AS rebalance_date, n AS n_realized, CASE WHEN n >= 50 THEN h / n END AS coverage,
  CASE WHEN n >= 50 THEN GREATEST(LEAST((h / n - 0.5) / (0.9 - 0.5), 1), 0) ELSE 0.5 END AS trust
FROM (SELECT e.trade_date, COUNT(r.hit) AS n, CAST(SUM(r.hit) AS DOUBLE) AS h FROM v_ends e LEFT JOIN v_freal r ON r.realized_date <= e.trade_date GROUP BY 1) e"""


@query("mod15_trust_gate_all_features", f"SELECT rebalance_date, n_realized, {v.rnd('coverage', 'trust')} FROM v_ftrust")
def mod15(d):
    return rounded(trust_gate(d.conformal_five(), trading_calendar(d.model()), period_ends(d.model())), ["coverage", "trust"])


@query("mod16_importance_all_features", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND(AVG(ABS(beta{j})), 6) AS mean, ROUND(COALESCE(STDDEV_SAMP(ABS(beta{j})), 0), 6) AS std FROM {importance_sql('v_fo')}" for j, f in enumerate(FEATURES, 1)))
def mod16(d):
    return rounded(importance_summary(ols_alpha(d.model(), embargoed(d), FEATURES, min_train_rows=MIN_ROWS).importance), ["mean", "std"])


v.V["v_fcorr"] = f"""SELECT e.trade_date, CASE WHEN COUNT(r.hit) >= 200 AND STDDEV_POP(r.confidence) > 0 THEN COALESCE(CORR(r.confidence, r.{v.LABEL}), 0) ELSE 0 END AS r
FROM (SELECT DISTINCT trade_date FROM v_fconf) e LEFT JOIN v_freal r ON r.realized_date <= e.trade_date GROUP BY 1"""
v.V["v_ftilted"] = """SELECT c.trade_date, ts_code,
  COALESCE((ml_score - AVG(ml_score) OVER g) / NULLIF(STDDEV_POP(ml_score) OVER g, 0), 0) + r.r * COALESCE((confidence - AVG(confidence) OVER g) / NULLIF(STDDEV_POP(confidence) OVER g, 0), 0) AS score
FROM v_fconf c JOIN v_fcorr r ON r.trade_date = c.trade_date WINDOW g AS (PARTITION BY c.trade_date)"""


@query("fac09_sign_tilt_all_features", f"SELECT trade_date, ts_code, {v.rnd('score', digits=5)} FROM v_ftilted")
def fac09(d):
    pred = d.conformal_five()
    c = realised_correlation(pred, trading_calendar(d.model()), pred.select("trade_date").distinct())
    return rounded(sign_tilt(pred, c).select("trade_date", "ts_code", "score"), ["score"], 5)


# one frozen window
v.V["v_f5z"] = rows_sql(source="v_model m", window="DATE '1998-12-31'", where="m.trade_date <= DATE '1998-12-31'")
v.V["v_f5zs"] = v.split("v_f5z")
residuals("v_fz", "v_f5zs", "NOT is_calibration")
v.V["v_fzq"] = v.conf_q(f"(SELECT s.*, ABS(y - ({fitted()})) AS score FROM v_fz_q{P} s JOIN (SELECT window_id, my, {', '.join(f't{j}' for j in SPAN)} FROM v_fz_t) USING (window_id) WHERE is_calibration)", 0.1)


@query("mod04_conformal_frozen_all_features", f"""SELECT trade_date, ts_code, ROUND({fitted()}, 6) + 0.0 AS ml_score, ROUND(q, 6) + 0.0 AS ci_half_width
FROM ({scored('v_fz', 'v_model', 'TRUE')}) JOIN v_fzq USING (window_id)
WHERE trade_date IN (SELECT MAX(trade_date) FROM v_cal WHERE trade_date >= DATE '1999-01-01' GROUP BY DATE_TRUNC('month', trade_date))""")
def mod04(d):
    plan = frozen_plan(d.model(), "1998-12-31", "1999-01-01")
    res = run(d, locally_adaptive=False, plan=plan)
    return rounded(res.predictions.select("trade_date", "ts_code", "ml_score", "ci_half_width"), ["ml_score", "ci_half_width"])
