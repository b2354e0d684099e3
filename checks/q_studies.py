"""Experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import risk
from alphaloom.operators.metrics import METRICS
from alphaloom.operators.positions import prepare_snapshot, snapshots
from alphaloom.operators.reports import seed_statistics, union_labelled, wins_over
from alphaloom.operators.staging import stage
from alphaloom.operators.training import ols_alpha
from alphaloom.plans import backtest, panels, studies
from checks import views as v
from checks.fixtures import EMBARGO, FEATURES, MIN_ROWS, TRAIN_MONTHS, r, rounded, split_key
from checks.q_portfolio import LIMITS, tilt_sql
from checks.registry import query

VARIANTS = {"fundamental_only": ("roe", "ep_ttm"), "technical_only": ("ret_20", "volatility_20", "turnover_20"), "full_factor": FEATURES}
CORE = METRICS[:14]

v.V["v_abl"] = " UNION ALL ".join(
    f"SELECT '{n}' AS variant, trade_date AS rebalance_date, ts_code, ROUND({v.mean_of(c)}, 8) AS score FROM v_model WHERE trade_date IN (SELECT trade_date FROM v_ends) AND {v.mean_of(c)} IS NOT NULL"
    for n, c in VARIANTS.items()
)
v.V["v_ablbook"] = v.top_n("v_abl", 20, "variant")
v.V["v_ablturn"] = v.turnover("v_ablbook", "variant")
v.V["v_ablnav"] = v.nav("v_ablbook", "v_ablturn", "variant")
v.V["v_abldiag"] = "SELECT *, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_ablturn"
v.V["v_ablmet"] = v.metrics("v_ablnav", "v_abldiag", "variant")
COUNTS = "CASE variant " + " ".join(f"WHEN '{n}' THEN {len(c)}" for n, c in VARIANTS.items()) + " END AS feature_count"


def shared(d, name, build):
    if name not in d._views:
        d._views[name] = build()
    return d._views[name]


def ablation(d):
    return shared(d, "ablation", lambda: studies.feature_ablation(d.model(), VARIANTS))


@query("exp01_feature_ablation", f"SELECT variant, {COUNTS}, {v.rnd(*CORE)} FROM v_ablmet")
def exp01(d):
    return rounded(studies.feature_ablation(d.model(), VARIANTS).metrics.select("variant", "feature_count", *CORE), CORE)


# --- constraint ablation: the SQL walks the turnover-limited path with a recursive query ---------
SETS = {"full_constraints": (0.08, 0.02, 0.2), "no_tracking_error": (10, 0.02, 0.2), "no_industry_deviation": (0.08, 10, 0.2), "no_turnover": (0.08, 0.02, 10)}


def path_sql(target: str, cap) -> str:
    return f"""
WITH RECURSIVE q AS (SELECT rebalance_date, ROW_NUMBER() OVER (ORDER BY rebalance_date) AS seq FROM (SELECT DISTINCT rebalance_date FROM {target})),
s AS (SELECT seq, ts_code, weight FROM {target} JOIN q USING (rebalance_date)),
walk AS (
  SELECT CAST(1 AS BIGINT) AS seq, ts_code, weight FROM s WHERE seq = 1
  UNION ALL
  SELECT seq, ts_code, CASE WHEN held > 0 THEN prev / held + CASE WHEN mv <= {cap} THEN 1 ELSE {cap} / mv END * (goal - prev / held) ELSE goal END AS weight
  FROM (SELECT *, SUM(ABS(goal - prev / NULLIF(held, 0))) OVER () / 2 AS mv FROM (
    SELECT s.seq, s.ts_code, s.weight AS goal, COALESCE(w.weight, 0) AS prev, SUM(COALESCE(w.weight, 0)) OVER () AS held
    FROM (SELECT MAX(seq) + 1 AS seq FROM walk) n JOIN s ON s.seq = n.seq LEFT JOIN walk w ON w.ts_code = s.ts_code)))
SELECT q.rebalance_date, ts_code, weight FROM walk JOIN q USING (seq) WHERE weight > 1e-12"""


v.V["v_path"] = "SELECT * FROM (" + path_sql("v_t", 0.2) + ")"
for name, (te, dev, cap) in SETS.items():
    tilt_sql("v_prep", te=te, dev=dev, name=f"v_x_{name}")
    v.V[f"v_p_{name}"] = "SELECT * FROM (" + path_sql(f"v_x_{name}", cap) + ")"
v.V["v_xpath"] = " UNION ALL ".join(f"SELECT '{n}' AS scenario, * FROM v_p_{n}" for n in SETS)
v.V["v_xfull"] = "SELECT s.scenario, p.rebalance_date, p.ts_code, p.industry_name, p.benchmark_weight, COALESCE(w.weight, 0) AS weight FROM v_prep p CROSS JOIN (SELECT DISTINCT scenario FROM v_xpath) s LEFT JOIN v_xpath w ON w.scenario = s.scenario AND w.rebalance_date = p.rebalance_date AND w.ts_code = p.ts_code"
v.V["v_xheld"] = "SELECT * FROM v_xfull WHERE weight > 1e-6"
v.V["v_xturn0"] = v.snap_turn("v_xfull", "scenario")
v.V["v_xturn"] = "SELECT scenario, rebalance_date, snapshot_turnover AS turnover FROM v_xturn0"
v.V["v_xavar"] = v.avar("v_xfull", "scenario")
v.V["v_xdev"] = "SELECT scenario, rebalance_date, MAX(ABS(e - b)) AS dev FROM (SELECT scenario, rebalance_date, industry_name, SUM(weight) AS e, SUM(benchmark_weight) AS b FROM v_xfull GROUP BY ALL) GROUP BY ALL"
v.V["v_xnav"] = v.nav("v_xheld", "v_xturn", "scenario")
v.V["v_xdiag"] = "SELECT scenario, rebalance_date, turnover, SQRT(active_variance * 252) AS te, dev FROM v_xturn JOIN v_xavar USING (scenario, rebalance_date) JOIN v_xdev USING (scenario, rebalance_date)"
v.V["v_xmet"] = v.metrics("v_xnav", "v_xdiag", "scenario")


@query("exp02_constraint_ablation", f"SELECT scenario, {v.rnd(*METRICS, digits=4)} FROM v_xmet")
def exp02(d):
    return rounded(studies.constraint_ablation(d.prepared(), d.labeled(), LIMITS).metrics, METRICS, 4)


SIZES = (10, 20, 30, 50)
v.V["v_nbook"] = " UNION ALL ".join(f"SELECT {n} AS top_n, * FROM ({v.top_n('v_snap', n)})" for n in SIZES)
v.V["v_nturn"] = v.turnover("v_nbook", "top_n")
v.V["v_nnav"] = v.nav("v_nbook", "v_nturn", "top_n")
v.V["v_ndiag"] = "SELECT *, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_nturn"
v.V["v_nmet"] = v.metrics("v_nnav", "v_ndiag", "top_n")


@query("exp03_top_n_sensitivity", f"SELECT top_n, {v.rnd(*CORE)} FROM v_nmet")
def exp03(d):
    return rounded(studies.top_n_sensitivity(d.scored(), SIZES).metrics.select("top_n", *CORE), CORE)


for s in studies.SEEDS:
    v.V[f"v_split_{s}"] = v.split("v_wrows", s)
    v.V[f"v_coef_{s}"] = v.ols(f"v_split_{s}", where="NOT is_calibration")
v.V["v_seed"] = " UNION ALL ".join(
    f"SELECT {s} AS seed, m.trade_date AS rebalance_date, m.ts_code, ROUND(c.intercept + c.slope * COALESCE(m.ret_20, 0), 8) AS score FROM v_model m JOIN v_coef_{s} c ON m.trade_date = c.window_id"
    for s in studies.SEEDS
)
v.V["v_seedbook"] = v.top_n("v_seed", 20, "seed")
v.V["v_seedturn"] = v.turnover("v_seedbook", "seed")
v.V["v_seednav"] = v.nav("v_seedbook", "v_seedturn", "seed")
v.V["v_seeddiag"] = "SELECT *, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_seedturn"
v.V["v_seedmet"] = v.metrics("v_seednav", "v_seeddiag", "seed")


def seeds(d):
    return shared(d, "seeds", lambda: stage(studies.seed_runs(d.model(), ["ret_20"], split_key, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO).metrics))


@query("exp04_seed_runs", f"SELECT seed, {v.rnd(*CORE)} FROM v_seedmet")
def exp04(d):
    return rounded(seeds(d).select("seed", *CORE), CORE)


@query("exp04_seed_runs_all_features")
def exp04d(d):
    run = studies.seed_runs(d.model(), FEATURES, split_key, train_months=TRAIN_MONTHS, min_train_rows=MIN_ROWS, embargo=EMBARGO)
    return run.metrics.select("seed", *CORE)


@query("exp04_seed_statistics", "SELECT ROUND(AVG(information_ratio), 6) AS mean, ROUND(STDDEV_SAMP(information_ratio), 6) + 0.0 AS std, ROUND(STDDEV_SAMP(information_ratio) / AVG(information_ratio), 5) + 0.0 AS cv, ROUND(MIN(information_ratio), 6) AS min, ROUND(MAX(information_ratio), 6) AS max FROM v_seedmet")
def exp04b(d):
    return rounded(rounded(seed_statistics(seeds(d), "information_ratio"), ["mean", "std", "min", "max"]), ["cv"], 5)


@query("exp04_wins_over_seed_baseline", "SELECT 'model' AS scheme, COUNT(*) AS seeds, CAST(SUM(CAST(m.information_ratio > n.information_ratio AS INT)) AS BIGINT) AS wins FROM v_seedmet m, v_metrics n")
def exp04c(d):
    base = backtest.from_positions(d.scored(), d.book()).metrics.select("information_ratio")
    every = seeds(d).select("seed", base.select("information_ratio").scalar().alias("information_ratio"))
    runs = union_labelled([("model", seeds(d).select("seed", "information_ratio")), ("factor", every)], "scheme")
    return wins_over(runs, "information_ratio", "factor", "scheme")


def weighted(d):
    return d.scored().withColumns({"benchmark_weight": F.col("amount"), "industry_name": F.coalesce("industry_name", F.lit("UNKNOWN"))})


@query("exp05_scheme_comparison")
def exp05(d):
    run = studies.compare_schemes(weighted(d), d.conformal(), "score", LIMITS, min_candidates=5)
    return studies.with_delta(run.metrics, "scheme", "conformal_ml_baseline")


def ols_run(d):
    """OLS score through the constrained tilt."""

    def build():
        pred = ols_alpha(d.model(), studies.rolling_plan(d.model(), TRAIN_MONTHS, EMBARGO), ["ret_20", "volatility_20", "turnover_20"], min_train_rows=MIN_ROWS).predictions
        snap = weighted(d).drop("score").join(pred.select("trade_date", "ts_code", F.col("ml_score").alias("score")), ["trade_date", "ts_code"])
        prepared = stage(prepare_snapshot(snap.withColumnRenamed("trade_date", "rebalance_date").select("rebalance_date", "ts_code", "industry_name", "benchmark_weight", "score")))
        return backtest.from_positions(d.labeled(), backtest.tilted_positions(prepared, d.labeled(), LIMITS))

    return shared(d, "ols_run", build)


@query("exp06_strategy_summary")
def exp06(d):
    base = backtest.from_positions(d.scored(), d.book())
    tilted = backtest.from_positions(d.labeled(), backtest.tilted_positions(d.prepared(), d.labeled(), LIMITS))
    return studies.summary_table([("equal_weight_baseline", base), ("composite_tilt", tilted), ("model_tilt", ols_run(d))], start="1997-01-01", end="2000-12-31")


@query("exp07_construction_comparison", f"SELECT 'rank_equal_weight' AS portfolio_construction, variant, {v.rnd(*CORE)} FROM v_ablmet UNION ALL SELECT 'constrained_optimizer', scenario, {v.rnd(*CORE, digits=4)} FROM v_xmet")
def exp07(d):
    opt = studies.constraint_ablation(d.prepared(), d.labeled(), LIMITS).metrics
    return studies.construction_comparison(rounded(opt.withColumnRenamed("scenario", "variant").select("variant", *CORE), CORE, 4), rounded(ablation(d).metrics.select("variant", *CORE), CORE))


@query("exp07_constructions_by_variant")
def exp07b(d):
    panel = d.model().withColumn("benchmark_weight", F.col("amount"))
    return studies.variant_constructions(panel, d.labeled(), VARIANTS, LIMITS).select("portfolio_construction", "variant", *CORE)


REGIMES = {f"Y{y}": (f"{y}-01-01", f"{y}-12-31") for y in range(1996, 2001)}
v.V["v_regnav"] = " UNION ALL ".join(
    f"SELECT '{n}' AS regime, * REPLACE (portfolio_nav / FIRST_VALUE(portfolio_nav) OVER o AS portfolio_nav, benchmark_nav / FIRST_VALUE(benchmark_nav) OVER o AS benchmark_nav, (portfolio_nav / FIRST_VALUE(portfolio_nav) OVER o) / (benchmark_nav / FIRST_VALUE(benchmark_nav) OVER o) AS excess_nav) FROM v_ablnav WHERE trade_date BETWEEN DATE '{a}' AND DATE '{b}' WINDOW o AS (PARTITION BY variant ORDER BY trade_date)"
    for n, (a, b) in REGIMES.items()
)
v.V["v_regall"] = "SELECT regime || '|' || variant AS rv, * EXCLUDE (regime, variant) FROM v_regnav"
v.V["v_regdiag"] = "SELECT regime || '|' || variant AS rv, turnover, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_ablturn JOIN (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in REGIMES.items()) + ") g(regime, a, b) ON rebalance_date BETWEEN a AND b"
v.V["v_regmet"] = v.metrics("v_regall", "v_regdiag", "rv")


def regimes(d):
    run = ablation(d)
    return studies.regime_metrics(run.nav, run.positions, REGIMES, ["variant"])


@query("exp08_regime_metrics", f"SELECT SPLIT_PART(rv, '|', 1) AS regime, SPLIT_PART(rv, '|', 2) AS variant, {v.rnd(*CORE)} FROM v_regmet")
def exp08(d):
    return rounded(regimes(d).select("regime", "variant", *CORE), CORE)


@query("exp08_regime_pivot", "SELECT SPLIT_PART(rv, '|', 1) AS regime, " + ", ".join(f"ROUND(MAX(annual_excess_return) FILTER (SPLIT_PART(rv, '|', 2) = '{n}'), 6) + 0.0 AS {n}" for n in VARIANTS) + " FROM v_regmet GROUP BY 1")
def exp08b(d):
    return rounded(studies.regime_table(regimes(d), list(VARIANTS), label="variant"), list(VARIANTS))


@query("exp09_horizon_pivot", "SELECT a.variant AS strategy, ROUND(a.information_ratio, 6) + 0.0 AS long_horizon, ROUND(b.information_ratio, 6) + 0.0 AS out_of_sample FROM v_ablmet a JOIN (SELECT SPLIT_PART(rv, '|', 2) AS variant, information_ratio FROM v_regmet WHERE rv LIKE 'Y2000|%') b USING (variant)")
def exp09(d):
    run = ablation(d)
    late = run.window("2000-01-01", "2000-12-31").metrics
    name = lambda m: m.withColumnRenamed("variant", "strategy")
    table = studies.horizon_table([("long_horizon", name(run.metrics)), ("out_of_sample", name(late))], "information_ratio")
    return rounded(table, ["long_horizon", "out_of_sample"])


@query("pnl05_point_in_time_model_panel", f"SELECT ts_code, trade_date, ROUND(ret_20, 6) + 0.0 AS ret_20, ROUND(turnover_20, 6) + 0.0 AS turnover_20, ROUND(benchmark_weight, 8) AS benchmark_weight FROM v_pitz")
def pit(d):
    feeds = panels.Feeds(d.bars(), industry=d.industry(), financials=d.financials().withColumnRenamed("netprofitmargin", "netprofit_margin"), benchmark=d.benchmark(), valuation=None, macro=[d.macro()])
    return panels.point_in_time_panel(feeds, d.membership()).select("ts_code", "trade_date", r("ret_20").alias("ret_20"), r("turnover_20").alias("turnover_20"), F.round("benchmark_weight", 8).alias("benchmark_weight"))


v.V["v_pit"] = """SELECT * EXCLUDE (p) REPLACE (COALESCE(industry_name, 'UNKNOWN') AS industry_name), COALESCE(p, MEDIAN(p) OVER (PARTITION BY trade_date), 1) AS proxy FROM (
  SELECT l.*, close * vol / NULLIF(turnover_rate, 0) AS p FROM v_labeled l SEMI JOIN v_member m ON m.ts_code = l.ts_code AND m.month = DATE_TRUNC('month', l.trade_date))"""
v.V["v_pitw"] = "SELECT *, proxy / SUM(proxy) OVER (PARTITION BY trade_date) AS benchmark_weight FROM v_pit"
v.V["v_pitx"] = v.wins("v_pitw", ("ret_20", "turnover_20"))
v.V["v_pitz"] = v.zs("v_pitx", ("ret_20", "turnover_20"))
