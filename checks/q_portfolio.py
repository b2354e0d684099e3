"""Positions, risk, tilts, uncertainty schemes, NAV and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import risk, tilt, uncertainty
from alphaloom.operators.calendar import period_ends, trading_calendar
from alphaloom.operators.conformal import trust_gate
from alphaloom.operators.metrics import METRICS, capture, monthly_win_rate, performance_metrics
from alphaloom.operators.nav import benchmark_by_day, daily_nav, drawdowns, gross_returns, slice_nav
from alphaloom.operators.positions import (
    blend,
    equal_weight_book,
    prepare_snapshot,
    snapshots,
    top_n,
    turnover,
)
from alphaloom.operators.staging import stage
from checks import views as v
from checks.fixtures import r, rounded
from checks.registry import query

LIMITS = risk.Limits(max_weight=0.10)


@query("prt01_rebalance_dates", "SELECT trade_date FROM v_ends UNION ALL SELECT MAX(trade_date) FROM v_cal GROUP BY DATE_TRUNC('year', trade_date)")
def prt01(d):
    return period_ends(d.bars()).select("trade_date").unionAll(period_ends(d.bars(), "year").select("trade_date"))


@query("prt02_top_n_equal_weight", "SELECT rebalance_date, ts_code, ROUND(weight, 8) AS weight, score FROM v_book")
def prt02(d):
    return top_n(snapshots(d.scored()), 20).select("rebalance_date", "ts_code", F.round("weight", 8).alias("weight"), "score")


@query("prt03_turnover", f"SELECT rebalance_date, {v.rnd('turnover')} FROM v_turn")
def prt03(d):
    return rounded(turnover(d.book()), ["turnover"])


PREP = ("benchmark_weight", "alpha_score")


@query("prt04_snapshot_preparation", f"SELECT rebalance_date, ts_code, industry_name, {v.rnd(*PREP)} FROM v_prep")
def prt04(d):
    snap = snapshots(d.scored().withColumn("benchmark_weight", F.col("amount")))
    return rounded(prepare_snapshot(snap).select("rebalance_date", "ts_code", "industry_name", *PREP), PREP)


def test_weights(d):
    """Benchmark tilted by alpha, not scaled to any limit."""
    w0 = F.col("benchmark_weight") * F.greatest(1.0 + 0.5 * F.col("alpha_score"), F.lit(0.0))
    rows = d.prepared().withColumn("_w", w0)
    total = rows.groupBy("rebalance_date").agg(F.sum("_w").alias("_s"))
    return rows.join(F.broadcast(total), "rebalance_date").withColumn("weight", F.col("_w") / F.col("_s")).drop("_w", "_s")


def history(d):
    if "history" not in d._views:
        d._views["history"] = risk.return_windows(d.prepared(), d.labeled(), 60)
        d._views["shrink"] = risk.shrinkage(d._views["history"], d.prepared(), 60)
    return d._views["history"], d._views["shrink"]


def diag(d):
    h, s = history(d)
    return risk.diagnostics(test_weights(d), h, s)


@query("prt05_industry_exposure", "SELECT rebalance_date, industry_name, ROUND(SUM(weight), 6) + 0.0 AS exposure, ROUND(SUM(benchmark_weight), 6) + 0.0 AS benchmark_exposure FROM v_wts GROUP BY ALL")
def prt05(d):
    return rounded(risk.industry_exposure(test_weights(d)), ["exposure", "benchmark_exposure"])


@query("rsk01_shrunk_covariance", f"SELECT rebalance_date, n_days, p, {v.rnd('mu', digits=10)}, {v.rnd('shrink')} FROM v_shrink")
def rsk01(d):
    return rounded(rounded(history(d)[1], ["mu"], 10), ["shrink"])


@query("rsk02_tracking_error", "SELECT rebalance_date, ROUND(SQRT(active_variance * 252), 6) + 0.0 AS ex_ante_tracking_error FROM v_avar")
def rsk02(d):
    return rounded(diag(d).select("rebalance_date", "ex_ante_tracking_error"), ["ex_ante_tracking_error"])


@query("rsk03_industry_deviation", f"SELECT rebalance_date, {v.rnd('max_industry_deviation')} FROM v_dev")
def rsk03(d):
    return rounded(risk.industry_deviation(test_weights(d)), ["max_industry_deviation"])


@query("rsk04_snapshot_turnover", f"SELECT rebalance_date, {v.rnd('snapshot_turnover', 'previous_held')} FROM v_sturn")
def rsk04(d):
    return rounded(risk.snapshot_turnover(test_weights(d)), ["snapshot_turnover", "previous_held"])


@query("rsk05_constraint_check", """SELECT rebalance_date, ABS(s - 1) <= 1e-6 AS fully_invested, mn >= -1e-6 AND mx <= 0.1 + 1e-6 AS weight_ok,
  active_variance <= POW(0.08, 2) / 252 + 1e-12 AS tracking_ok, max_industry_deviation <= 0.02 + 1e-6 AS industry_ok,
  previous_held <= 0 OR snapshot_turnover <= 0.2 + 1e-6 AS turnover_ok
FROM (SELECT rebalance_date, SUM(weight) AS s, MIN(weight) AS mn, MAX(weight) AS mx FROM v_wts GROUP BY 1)
JOIN v_avar USING (rebalance_date) JOIN v_dev USING (rebalance_date) JOIN v_sturn USING (rebalance_date)""")
def rsk05(d):
    return risk.check_constraints(test_weights(d), diag(d), LIMITS)


@query("rsk06_objective", """SELECT rebalance_date, ROUND(g - 5 * active_variance - 0.002 * 2 * snapshot_turnover - 0.1 * u, 6) + 0.0 AS objective
FROM (SELECT rebalance_date, SUM(alpha_score * weight) AS g, SUM(0.5 * weight * weight) AS u FROM v_wts GROUP BY 1) JOIN v_avar USING (rebalance_date) JOIN v_sturn USING (rebalance_date)""")
def rsk06(d):
    w = test_weights(d).withColumn("confidence", F.lit(0.5))
    return rounded(risk.objective(w, diag(d), LIMITS, gamma=0.1), ["objective"])


def level_sql(src: str, group: str, weight: str, total: str, cap: float, out: str) -> str:
    """``weight`` cut at ``cap`` and levelled so that the group keeps its sum of ``total``."""
    order = f"(PARTITION BY {group} ORDER BY {weight} DESC, ts_code"
    return f"""SELECT s.*, CASE WHEN l.lam IS NULL THEN CASE WHEN s.{weight} > 0 THEN {cap} ELSE 0 END ELSE LEAST({cap}, l.lam * s.{weight}) END AS {out}
FROM {src} s LEFT JOIN (SELECT {group}, ARG_MIN(lam, r) AS lam FROM (
  SELECT {group}, r, {weight} AS w, (tot - (r - 1) * CAST({cap} AS DOUBLE)) / (sm - above) AS lam FROM (
    SELECT {group}, {weight}, ROW_NUMBER() OVER {order}) AS r,
      COALESCE(SUM({weight}) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
      SUM({weight}) OVER (PARTITION BY {group}) AS sm, SUM({total}) OVER (PARTITION BY {group}) AS tot FROM {src}) WHERE {weight} > 0)
  WHERE lam * w <= {cap} + 1e-12 GROUP BY {group}) l USING ({group})"""


def tilt_sql(src: str, cap: float = 0.10, te: float = 0.08, dev: float = 0.02, gamma: float = 0.0, conf: str = "0.5", extra: str = "0", name: str = "v_t") -> str:
    """Views of one tilt over a prepared source; returns the name of the weights view."""
    V = v.V
    V[name + "_i"] = level_sql(src, "rebalance_date, industry_name", "benchmark_weight", "benchmark_weight", cap, "inside")
    V[name + "_p"] = level_sql(name + "_i", "rebalance_date", "inside", "benchmark_weight", cap, "base")
    V[name + "_o"] = f"SELECT *, base AS weight FROM {name}_p"
    V[name + "_ov"] = v.avar(name + "_o", "", extra)
    V[name + "_og"] = f"""SELECT rebalance_date, ABS(SUM(e)) AS lost, MAX(ABS(e)) AS gap0 FROM (
  SELECT rebalance_date, industry_name, SUM(base - benchmark_weight) AS e FROM {name}_p GROUP BY ALL) GROUP BY ALL"""
    V[name + "_c"] = f"""SELECT *, w0 * sb / s0 - base AS a FROM (
  SELECT *, SUM(w0) OVER g AS s0, SUM(base) OVER g AS sb FROM (
    SELECT p.*, c.candidate, CASE WHEN c.neutral THEN industry_name ELSE '' END AS sc, base * GREATEST(1 + c.k * alpha_score, 0) AS w0
    FROM {name}_p p CROSS JOIN (VALUES (0, 0.0, TRUE), (1, 0.25, TRUE), (2, 0.25, FALSE), (3, 0.5, TRUE), (4, 0.5, FALSE), (5, 1.0, TRUE), (6, 1.0, FALSE), (7, 2.0, TRUE), (8, 2.0, FALSE)) c(candidate, k, neutral))
  WINDOW g AS (PARTITION BY rebalance_date, candidate, sc))"""
    V[name + "_a"] = f"SELECT * EXCLUDE (a) REPLACE (w0 AS w0), CASE WHEN s0 > 0 THEN a ELSE 0 END AS a, CASE WHEN s0 > 0 THEN a ELSE 0 END + benchmark_weight AS weight FROM {name}_c"
    V[name + "_v"] = v.avar(name + "_a", "candidate", extra)
    V[name + "_b"] = f"""SELECT *, LEAST(1, COALESCE(room, 1), COALESCE(CASE WHEN active_variance > 1e-18 THEN ({te} / SQRT(252) - SQRT(var0)) / SQRT(active_variance) END, 1),
    COALESCE(CASE WHEN gap > 1e-12 THEN ({dev} - gap0) / gap END, 1)) AS th
FROM (SELECT rebalance_date, candidate, MIN(CASE WHEN a > 1e-15 THEN GREATEST({cap} - base, 0) / a END) AS room,
    SUM(alpha_score * base) AS g0, SUM(alpha_score * a) AS g1, SUM((1 - {conf}) * base * base) AS d0,
    SUM(2 * (1 - {conf}) * base * a) AS d1, SUM((1 - {conf}) * a * a) AS d2 FROM {name}_a GROUP BY ALL)
JOIN (SELECT rebalance_date, candidate, MAX(ABS(e)) AS gap FROM (SELECT rebalance_date, candidate, industry_name, SUM(a) AS e FROM {name}_a GROUP BY ALL) GROUP BY ALL) USING (rebalance_date, candidate)
JOIN {name}_v USING (rebalance_date, candidate) JOIN {name}_og USING (rebalance_date)
JOIN (SELECT rebalance_date, active_variance AS var0 FROM {name}_ov) USING (rebalance_date)"""
    V[name + "_s"] = f"""SELECT rebalance_date, candidate, th FROM {name}_b WHERE lost <= 1e-9 AND gap0 <= {dev} AND SQRT(var0) <= {te} / SQRT(252)
QUALIFY ROW_NUMBER() OVER (PARTITION BY rebalance_date ORDER BY ROUND(g0 + th * g1 - 5 * POW(SQRT(var0) + th * SQRT(active_variance), 2) - {gamma} * (d0 + th * d1 + th * th * d2), 9) DESC, candidate) = 1"""
    V[name + "_f"] = f"SELECT a.* REPLACE (a.base + s.th * a.a AS weight) FROM {name}_a a JOIN {name}_s s USING (rebalance_date, candidate)"
    V[name + "_m"] = f"""SELECT p.rebalance_date, p.ts_code, p.benchmark_weight, f.weight AS old,
    (SELECT MAX(s.rebalance_date) FROM {name}_s s WHERE s.rebalance_date < p.rebalance_date) AS prior FROM {src} p
  LEFT JOIN {name}_f f ON f.ts_code = p.ts_code AND f.rebalance_date = (SELECT MAX(s.rebalance_date) FROM {name}_s s WHERE s.rebalance_date < p.rebalance_date)
  WHERE p.rebalance_date NOT IN (SELECT rebalance_date FROM {name}_s)"""
    V[name] = f"""SELECT rebalance_date, ts_code, weight, 'tilted' AS optimization_status FROM {name}_f
UNION ALL SELECT rebalance_date, ts_code, CASE WHEN SUM(old) OVER g > 0 THEN COALESCE(old, 0) / SUM(old) OVER g ELSE benchmark_weight END,
  CASE WHEN SUM(old) OVER g > 0 THEN 'fallback_previous' ELSE 'fallback_benchmark' END FROM {name}_m WINDOW g AS (PARTITION BY rebalance_date)"""
    return name


tilt_sql("v_prep")


def base_tilt(d):
    if "tilt" not in d._views:
        h, s = history(d)
        d._views["tilt"] = stage(tilt.tilt(d.prepared(), h, s, LIMITS))
    return d._views["tilt"]


@query("prt06_constrained_tilt", f"SELECT rebalance_date, ts_code, {v.rnd('weight', digits=5)}, optimization_status FROM v_t")
def prt06(d):
    h, s = history(d)
    return rounded(tilt.tilt(d.prepared(), h, s, LIMITS).select("rebalance_date", "ts_code", "weight", "optimization_status"), ["weight"], 5)


v.V["v_tfeas"] = """SELECT rebalance_date, COUNT(*) AS n, ABS(SUM(weight) - 1) <= 1e-6 AS invested, MIN(weight) >= -1e-9 AS long_only,
  MAX(weight) <= 0.1 + 1e-6 AS within_cap, MIN(optimization_status) = 'tilted' AS tilted FROM v_t GROUP BY 1"""


@query("prt06_tilt_is_feasible", "SELECT * FROM v_tfeas")
def prt06b(d):
    t = base_tilt(d)
    capped, tilted = F.max("weight") <= 0.1 + 1e-6, F.min("optimization_status") == "tilted"
    return t.groupBy("rebalance_date").agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.sum("weight") - 1.0) <= 1e-6).alias("invested"), (F.min("weight") >= -1e-9).alias("long_only"), capped.alias("within_cap"), tilted.alias("tilted")
    )


@query("prt07_turnover_limited_path", "SELECT rebalance_date, ts_code, ROUND(weight, 5) AS weight FROM v_path WHERE weight > 1e-6")
def prt07(d):
    path = tilt.turnover_path(base_tilt(d).select("rebalance_date", "ts_code", "weight"), LIMITS)
    return rounded(path.where("weight > 1e-6"), ["weight"], 5)


v.V["v_pfull"] = "SELECT p.*, COALESCE(w.weight, 0) AS weight FROM v_prep p LEFT JOIN v_path w USING (rebalance_date, ts_code)"
v.V["v_pavar"] = v.avar("v_pfull")
v.V["v_psturn"] = v.snap_turn("v_pfull")
v.V["v_pdev"] = """SELECT rebalance_date, MAX(ABS(e - b)) AS max_industry_deviation FROM (
  SELECT rebalance_date, industry_name, SUM(weight) AS e, SUM(benchmark_weight) AS b FROM v_pfull GROUP BY ALL) GROUP BY 1"""


@query("prt07_path_diagnostics", """SELECT rebalance_date, ABS(s - 1) <= 1e-6 AS fully_invested, mn >= -1e-6 AND mx <= 0.1 + 1e-6 AS weight_ok,
  active_variance <= POW(0.08, 2) / 252 + 1e-12 AS tracking_ok, max_industry_deviation <= 0.02 + 1e-6 AS industry_ok,
  previous_held <= 0 OR snapshot_turnover <= 0.2 + 1e-6 AS turnover_ok
FROM (SELECT rebalance_date, SUM(weight) AS s, MIN(weight) AS mn, MAX(weight) AS mx FROM v_pfull GROUP BY 1)
JOIN v_pavar USING (rebalance_date) JOIN v_pdev USING (rebalance_date) JOIN v_psturn USING (rebalance_date)""")
def prt07b(d):
    """The finished path, checked again against every constraint."""
    path = tilt.turnover_path(base_tilt(d).select("rebalance_date", "ts_code", "weight"), LIMITS)
    full = d.prepared().join(path, ["rebalance_date", "ts_code"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    h, s = history(d)
    full = stage(full)
    return risk.check_constraints(full, risk.diagnostics(full, h, s), LIMITS)


@query("prt08_fallback_status", "SELECT rebalance_date, MIN(optimization_status) AS optimization_status, ROUND(SUM(weight), 6) AS total FROM v_tcap GROUP BY 1")
def prt08(d):
    """A weight cap many dates cannot meet: shows every fallback that occurs."""
    h, s = history(d)
    out = tilt.tilt(d.prepared(), h, s, risk.Limits(max_weight=0.07))
    return out.groupBy("rebalance_date").agg(F.min("optimization_status").alias("optimization_status"), F.round(F.sum("weight"), 6).alias("total"))


tilt_sql("v_prep", cap=0.07, name="v_tcap")

# --- uncertainty schemes: interval confidence joined to the snapshot ---------------------------
v.V["v_cprep"] = """SELECT p.*, c.ci_half_width, COALESCE(c.confidence, MEDIAN(c.confidence) OVER (PARTITION BY p.rebalance_date)) AS cf
FROM v_prep p LEFT JOIN v_conf c ON c.trade_date = p.rebalance_date AND c.ts_code = p.ts_code"""
v.V["v_cready"] = "SELECT * EXCLUDE (cf), CASE WHEN cf IS NULL THEN 0.5 ELSE LEAST(GREATEST(cf, 0), 1) END AS confidence FROM v_cprep"


def confident(d):
    if "confident" not in d._views:
        pred = d.conformal().select(F.col("trade_date").alias("rebalance_date"), "ts_code", "confidence", "ci_half_width")
        d._views["confident"] = stage(uncertainty.prepare_confidence(d.prepared().join(pred, ["rebalance_date", "ts_code"], "left")))
    return d._views["confident"]


@query("unc01_alpha_scale", "SELECT rebalance_date, ts_code, ROUND(alpha_score * POW(confidence, 2), 6) + 0.0 AS alpha_score FROM v_cready")
def unc01(d):
    return rounded(uncertainty.alpha_scale(confident(d), beta=2.0).select("rebalance_date", "ts_code", "alpha_score"), ["alpha_score"])


@query("unc02_candidate_filter", """SELECT rebalance_date, ts_code, ROUND(confidence, 6) + 0.0 AS confidence FROM v_cready
QUALIFY ROW_NUMBER() OVER (PARTITION BY rebalance_date ORDER BY ROUND(confidence, 9) DESC, ts_code) <= GREATEST(CEIL(COUNT(*) OVER (PARTITION BY rebalance_date) * CAST(0.7 AS DOUBLE)), LEAST(5, COUNT(*) OVER (PARTITION BY rebalance_date)))""")
def unc02(d):
    rows = confident(d).withColumn("confidence", F.round("confidence", 9))
    return rounded(uncertainty.candidate_filter(rows, 0.7, 5).select("rebalance_date", "ts_code", "confidence"), ["confidence"])


tilt_sql("v_cready", gamma=0.1, conf="confidence", name="v_tgam")


@query("unc03_objective_penalty", f"SELECT rebalance_date, ts_code, {v.rnd('weight', digits=5)} FROM v_tgam")
def unc03(d):
    h, s = history(d)
    return rounded(tilt.tilt(confident(d), h, s, LIMITS, gamma=0.1).select("rebalance_date", "ts_code", "weight"), ["weight"], 5)


v.V["v_hw"] = """SELECT * EXCLUDE (v2), COALESCE(v2 / AVG(v2) OVER (PARTITION BY rebalance_date) * (COALESCE(mu, 0) + 1e-4), 0) AS extra_variance FROM (
  SELECT p.*, s.mu, POW(COALESCE(ci_half_width, CASE WHEN md > 0 THEN md ELSE 1 END), 2) AS v2 FROM (SELECT *, MEDIAN(ci_half_width) OVER (PARTITION BY rebalance_date) AS md FROM v_cready) p
  LEFT JOIN v_shrink s USING (rebalance_date))"""
tilt_sql("v_hw", extra="extra_variance", name="v_thw")


@query("unc04_half_width_variance", "SELECT rebalance_date, ts_code, ROUND(extra_variance * 1e4, 6) + 0.0 AS extra_variance FROM v_hw")
def unc04(d):
    out = risk.half_width_variance(confident(d), history(d)[1])
    return out.select("rebalance_date", "ts_code", r(F.col("extra_variance") * 1e4).alias("extra_variance"))


@query("unc04_uncertainty_risk_tilt", f"SELECT rebalance_date, ts_code, {v.rnd('weight', digits=5)} FROM v_thw")
def unc04b(d):
    h, s = history(d)
    rows = stage(risk.half_width_variance(confident(d), s))
    return rounded(tilt.tilt(rows, h, s, LIMITS).select("rebalance_date", "ts_code", "weight"), ["weight"], 5)


@query("unc05_confidence_preparation", f"SELECT rebalance_date, ts_code, {v.rnd('confidence')} FROM v_cready")
def unc05(d):
    return rounded(confident(d).select("rebalance_date", "ts_code", "confidence"), ["confidence"])


@query("unc06_average_confidence", "SELECT rebalance_date, ROUND(SUM(confidence * (weight + 1e-12)) / SUM(weight + 1e-12), 6) AS avg_confidence FROM v_cready JOIN v_t USING (rebalance_date, ts_code) GROUP BY 1")
def unc06(d):
    rows = confident(d).join(base_tilt(d).select("rebalance_date", "ts_code", "weight"), ["rebalance_date", "ts_code"])
    return rounded(uncertainty.average_confidence(rows), ["avg_confidence"])


v.V["v_blend0"] = """SELECT rebalance_date, ts_code, g * COALESCE(a.weight, 0) + (1 - g) * COALESCE(b.weight, 0) AS weight
FROM v_t a FULL JOIN v_book b USING (rebalance_date, ts_code) LEFT JOIN (SELECT rebalance_date, trust AS g FROM v_trust) USING (rebalance_date)"""
v.V["v_blend"] = "SELECT rebalance_date, ts_code, weight / SUM(weight) OVER (PARTITION BY rebalance_date) AS weight FROM v_blend0"
v.V["v_bturn"] = v.turnover("v_blend")


def blended(d):
    if "blended" not in d._views:
        trust = stage(trust_gate(d.conformal(), trading_calendar(d.model()), period_ends(d.model())))
        d._views["blended"] = stage(blend(base_tilt(d), d.book(), trust))
    return d._views["blended"]


@query("unc07_trust_gated_blend", f"SELECT rebalance_date, ts_code, {v.rnd('weight', 'turnover', digits=5)} FROM v_blend JOIN v_bturn USING (rebalance_date)")
def unc07(d):
    return rounded(blended(d), ["weight", "turnover"], 5)


# --- NAV and metrics ---------------------------------------------------------------------------
NAV = ("portfolio_return", "gross_portfolio_return", "benchmark_return", "excess_return", "transaction_cost", "portfolio_nav", "benchmark_nav", "excess_nav")


@query("bkt01_gross_return", "SELECT trade_date, ROUND(gross_portfolio_return, 6) + 0.0 AS gross_portfolio_return FROM v_nav WHERE trade_date IN (SELECT trade_date FROM v_held)")
def bkt01(d):
    return rounded(gross_returns(d.scored(), d.book()), ["gross_portfolio_return"])


v.V["v_held"] = """SELECT DISTINCT c.trade_date FROM v_cal c JOIN v_book p ON p.rebalance_date = (SELECT MAX(b.rebalance_date) FROM v_book b WHERE b.rebalance_date < c.trade_date)
JOIN v_labeled l ON l.ts_code = p.ts_code AND l.trade_date = c.trade_date AND l.daily_return IS NOT NULL"""


@query("bkt02_benchmark_return", f"SELECT trade_date, ROUND(COALESCE(ARG_MIN_NULL(benchmark_daily_return, ts_code), 0), 6) + 0.0 AS benchmark_return FROM v_labeled GROUP BY 1")
def bkt02(d):
    return rounded(benchmark_by_day(d.labeled()), ["benchmark_return"])


@query("bkt03_nav_with_costs", f"SELECT trade_date, {v.rnd(*NAV)} FROM v_nav")
def bkt03(d):
    return rounded(daily_nav(d.scored(), d.book()), NAV)


v.V["v_bnav"] = v.nav("v_blend", "v_bturn")


@query("bkt04_nav_of_any_positions", f"SELECT trade_date, {v.rnd(*NAV, digits=5)} FROM v_bnav")
def bkt04(d):
    return rounded(daily_nav(d.labeled(), blended(d)), NAV, 5)


@query("bkt05_performance_metrics", f"SELECT {v.rnd(*v.METRICS)} FROM v_metrics")
def bkt05(d):
    return rounded(performance_metrics(d.nav(), d.book()), METRICS)


@query("bkt06_monthly_win_rate", "SELECT ROUND(monthly_win_rate, 6) AS monthly_win_rate FROM v_metrics")
def bkt06(d):
    return rounded(monthly_win_rate(d.nav(), []), ["monthly_win_rate"])


@query("bkt07_capture_ratios", f"SELECT {v.rnd('upside_capture', 'downside_capture')} FROM v_metrics")
def bkt07(d):
    return d.nav().agg(r(capture(True)).alias("upside_capture"), r(capture(False)).alias("downside_capture"))


v.V["v_cut"] = """SELECT * REPLACE (portfolio_nav / FIRST_VALUE(portfolio_nav) OVER o AS portfolio_nav, benchmark_nav / FIRST_VALUE(benchmark_nav) OVER o AS benchmark_nav,
  (portfolio_nav / FIRST_VALUE(portfolio_nav) OVER o) / (benchmark_nav / FIRST_VALUE(benchmark_nav) OVER o) AS excess_nav)
FROM v_nav WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' WINDOW o AS (ORDER BY trade_date)"""
v.V["v_cutdiag"] = "SELECT * FROM v_tdiag WHERE rebalance_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"
v.V["v_cutmet"] = v.metrics("v_cut", "v_cutdiag")


@query("bkt08_test_window_metrics", f"SELECT {v.rnd(*v.METRICS)} FROM v_cutmet")
def bkt08(d):
    pos = d.book().where("rebalance_date BETWEEN DATE'1998-01-01' AND DATE'1999-12-31'")
    return rounded(performance_metrics(slice_nav(d.nav(), "1998-01-01", "1999-12-31"), pos), METRICS)


@query("bkt09_drawdowns", """SELECT trade_date, ROUND(portfolio_nav / MAX(portfolio_nav) OVER o - 1, 6) + 0.0 AS drawdown, ROUND(benchmark_nav / MAX(benchmark_nav) OVER o - 1, 6) + 0.0 AS benchmark_drawdown
FROM v_nav WINDOW o AS (ORDER BY trade_date)""")
def bkt09(d):
    return rounded(drawdowns(d.nav()), ["drawdown", "benchmark_drawdown"])


@query("prt02_position_table", "SELECT rebalance_date, ts_code, ROUND(weight, 8) AS weight, score, industry_name, ROUND(turnover, 6) AS turnover, 'equal_weight' AS optimization_status FROM v_book JOIN v_turn USING (rebalance_date)")
def prt02b(d):
    out = equal_weight_book(d.scored(), 20).select("rebalance_date", "ts_code", F.round("weight", 8).alias("weight"), "score", "industry_name", "turnover", "optimization_status")
    return rounded(out, ["turnover"])
