"""Model studies over feature sets with external series, and the table of configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators.cross_section import composite_score
from alphaloom.operators.training import ols_variants
from alphaloom.plans import studies
from checks import views as v
from checks.fixtures import EMBARGO, FEATURES, MIN_ROWS, TRAIN_MONTHS, r, rounded
from checks.q_five import embargoed, fitted, residuals, rows_sql, scored
from checks.q_portfolio import LIMITS, tilt_sql
from checks.q_studies import CORE, path_sql
from checks.registry import query

EXTERNAL = ("northbound_net_inflow", "m2_yoy", "cn_spread_10y_2y")
VARIANTS = {
    "fundamental_only": ("roe", "ep_ttm"),
    "technical_only": ("ret_20", "volatility_20", "turnover_20"),
    "full_factor": FEATURES,
    "full_with_external": (*FEATURES, *EXTERNAL),
}

v.V["v_flow"] = "SELECT trade_date, SUM(CASE WHEN ts_code % 7 <= 1 THEN cents END) / 1e2 AS northbound_net_inflow FROM v_daily GROUP BY 1 HAVING COUNT(CASE WHEN ts_code % 7 <= 1 THEN 1 END) > 0"
v.V["v_spread"] = """SELECT CASE WHEN m <= 11 THEN MAKE_DATE(y, m + 1, 5) ELSE MAKE_DATE(y + 1, m - 11, 5) END AS trade_date, CAST(high AS DOUBLE) / CAST(every AS DOUBLE) AS cn_spread_10y_2y
FROM (SELECT CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, SUM(CASE WHEN o_orderpriority < '3' THEN CAST(ROUND(o_totalprice * 100) AS BIGINT) END) AS high,
  SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS every FROM orders GROUP BY 1, 2)"""
v.V["v_ext"] = """SELECT m.* EXCLUDE (macro_yoy), m.macro_yoy AS m2_yoy, f.northbound_net_inflow, s.cn_spread_10y_2y
FROM v_model m LEFT JOIN v_flow f ON f.trade_date = m.trade_date ASOF LEFT JOIN v_spread s ON m.trade_date >= s.trade_date"""

ROLLED = "JOIN v_cal c ON m.trade_date = c.trade_date JOIN {w} w ON c.idx BETWEEN w.first_idx AND w.last_idx"


def model_view(name: str, features, windows: str = "v_win") -> str:
    """View of one feature set's scores on its windows' dates."""
    v.V[f"{name}_rows"] = rows_sql(features, f"v_ext m {ROLLED.format(w=windows)}")
    residuals(name, f"{name}_rows", "TRUE", len(features))
    v.V[f"{name}_score"] = f"SELECT trade_date AS rebalance_date, ts_code, amount, industry_name, ROUND({fitted(p=len(features))}, 8) AS score FROM ({scored(name, 'v_ext', 'm.trade_date = t.window_id', features)})"
    return f"{name}_score"


SCORES = {n: model_view(f"v_va{k}", f) for k, (n, f) in enumerate(VARIANTS.items())}
v.V["v_mabl"] = " UNION ALL ".join(f"SELECT '{n}' AS variant, rebalance_date, ts_code, score FROM {s}" for n, s in SCORES.items())
v.V["v_mbook"] = v.top_n("v_mabl", 20, "variant")
v.V["v_mturn"] = v.turnover("v_mbook", "variant")
v.V["v_mnav"] = v.nav("v_mbook", "v_mturn", "variant")
v.V["v_mdiag"] = "SELECT *, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_mturn"
v.V["v_mmet"] = v.metrics("v_mnav", "v_mdiag", "variant")
COUNTS = "CASE variant " + " ".join(f"WHEN '{n}' THEN {len(c)}" for n, c in VARIANTS.items()) + " END AS feature_count"


@query("exp01_model_scores_by_variant", "SELECT variant, rebalance_date AS trade_date, ts_code, score + 0.0 AS ml_score FROM v_mabl")
def exp01b(d):
    out = ols_variants(d.external(), embargoed(d), VARIANTS, min_train_rows=MIN_ROWS).predictions
    return rounded(out.select("variant", "trade_date", "ts_code", "ml_score"), ["ml_score"], 8)


@query("exp01_model_ablation_with_external", f"SELECT variant, {COUNTS}, {v.rnd(*CORE)} FROM v_mmet")
def exp01(d):
    run = studies.model_ablation(d.external(), embargoed(d), VARIANTS, min_train_rows=MIN_ROWS)
    return rounded(run.metrics.select("variant", "feature_count", *CORE), CORE)


# --- configurations through the constrained tilt -------------------------------------------------
CONFIGS = {"baseline": None, "model": model_view("v_vleak", FEATURES, "v_roll"), "model_embargoed": SCORES["full_factor"], "model_external": SCORES["full_with_external"]}
v.V["v_cfgbase"] = "SELECT rebalance_date, ts_code, amount, industry_name, score FROM v_snap"
for name, source in CONFIGS.items():
    v.V[f"v_cfgp_{name}"] = v.prep(source or "v_cfgbase")
v.V["v_cfgprep"] = " UNION ALL ".join(f"SELECT '{n}' AS config, * FROM v_cfgp_{n}" for n in CONFIGS)
# risk on all codes that any configuration scores
v.V["v_cfgcodes"] = "SELECT DISTINCT rebalance_date, ts_code FROM v_cfgprep"
RISK = {"v_prep": "v_cfgcodes", "v_hist": "v_cfghist", "v_cent": "v_cfgcent", "v_shrink": "v_cfgshrink"}


def on_all_codes(text: str) -> str:
    for a, b in RISK.items():
        text = text.replace(f"{a} ", f"{b} ").replace(f"{a}\n", f"{b}\n").replace(f"{a})", f"{b})")
    return text


for a in ("v_hist", "v_cent", "v_shrink"):
    v.V[RISK[a]] = on_all_codes(v.V[a] + "\n")
for name in CONFIGS:
    made = set(v.V)
    tilt_sql(f"v_cfgp_{name}", name=f"v_cfgt_{name}")
    for view in set(v.V) - made:
        v.V[view] = on_all_codes(v.V[view] + "\n")
    v.V[f"v_cfgw_{name}"] = "SELECT * FROM (" + path_sql(f"v_cfgt_{name}", 0.2) + ")"
v.V["v_cfgpath"] = " UNION ALL ".join(f"SELECT '{n}' AS config, * FROM v_cfgw_{n}" for n in CONFIGS)
v.V["v_cfgfull"] = "SELECT p.*, COALESCE(w.weight, 0) AS weight FROM v_cfgprep p LEFT JOIN v_cfgpath w USING (config, rebalance_date, ts_code)"
v.V["v_cfgheld"] = "SELECT * FROM v_cfgfull WHERE weight > 1e-6"
v.V["v_cfgturn0"] = v.snap_turn("v_cfgfull", "config")
v.V["v_cfgturn"] = "SELECT config, rebalance_date, snapshot_turnover AS turnover FROM v_cfgturn0"
v.V["v_cfgavar"] = on_all_codes(v.avar("v_cfgfull", "config") + "\n")
v.V["v_cfgdev"] = "SELECT config, rebalance_date, MAX(ABS(e - b)) AS dev FROM (SELECT config, rebalance_date, industry_name, SUM(weight) AS e, SUM(benchmark_weight) AS b FROM v_cfgfull GROUP BY ALL) GROUP BY ALL"
v.V["v_cfgnav"] = v.nav("v_cfgheld", "v_cfgturn", "config")
v.V["v_cfgdiag"] = "SELECT config, rebalance_date, turnover, SQRT(active_variance * 252) AS te, dev FROM v_cfgturn JOIN v_cfgavar USING (config, rebalance_date) JOIN v_cfgdev USING (config, rebalance_date)"
v.V["v_cfgmet"] = v.metrics("v_cfgnav", "v_cfgdiag", "config")
SHOWN = ("information_ratio", "annual_excess_return", "max_drawdown", "tracking_error", "annual_turnover", "final_nav")


@query("exp06_configuration_table", f"SELECT config, {v.rnd(*SHOWN, digits=4)} FROM v_cfgmet JOIN (SELECT config, ARG_MAX(portfolio_nav, trade_date) AS final_nav FROM v_cfgnav GROUP BY 1) USING (config)")
def exp06(d):
    # the external panel has the factors of the scored one, so its score needs no join of the two
    panel = d.external().where("ts_code IS NOT NULL AND trade_date IS NOT NULL").withColumn("score", r(composite_score(FEATURES), 8))
    panel = panel.withColumns({"benchmark_weight": F.col("amount"), "industry_name": F.coalesce("industry_name", F.lit("UNKNOWN"))})
    scores = studies.configurations(panel, FEATURES, EXTERNAL, "score", TRAIN_MONTHS, MIN_ROWS, EMBARGO)
    return rounded(studies.configuration_table(panel, scores, d.labeled(), LIMITS), SHOWN, 4)
