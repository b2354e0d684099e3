"""Research panel, factors, labels, cross-sections and the flagship back-test."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.cross_section import (
    composite_score,
    equal_weight_score,
    model_panel,
    winsorize_mad,
    zscore,
)
from alphaloom.operators.factors import compute_factors, excess_return_label, resolve_features
from alphaloom.operators.joins import members_only
from alphaloom.operators.membership import (
    benchmark_profile,
    carry_membership,
    enrich_panel,
    float_cap_weights,
    membership_span,
    patch_industry,
    unknown_share,
)
from alphaloom.operators.metrics import METRICS, performance_metrics
from alphaloom.operators.nav import daily_nav
from alphaloom.operators.positions import equal_weight_book
from alphaloom.operators.staging import stage
from alphaloom.sources.conform import redate_snapshot
from checks import views as v
from checks.fixtures import FEATURES, r, rounded
from checks.registry import query

v.V["v_mom"] = v.zs("v_momw", ("ret_20",))
v.V["v_momw"] = v.wins("v_labeled", ("ret_20",))
v.V["v_momsnap"] = """SELECT trade_date AS rebalance_date, ts_code, ROUND(ret_20, 8) AS score FROM v_mom
WHERE trade_date IN (SELECT trade_date FROM v_ends) AND ret_20 IS NOT NULL"""
v.V["v_mombook"] = v.top_n("v_momsnap", 20)
v.V["v_momturn"] = v.turnover("v_mombook")
v.V["v_momnav"] = v.nav("v_mombook", "v_momturn")
v.V["v_momdiag"] = "SELECT *, CAST(NULL AS DOUBLE) AS te, CAST(NULL AS DOUBLE) AS dev FROM v_momturn"
v.V["v_mommet"] = v.metrics("v_momnav", "v_momdiag")


COLUMNS = ("ts_code", "trade_date", "industry_name", "daily_return", "ret_20", "benchmark_daily_return")


@query("flagship_momentum_metrics", f"SELECT {v.rnd(*v.METRICS)} FROM v_mommet")
def flagship(d):
    """Momentum, winsorize, industry z-score, month-end top 20, costs, NAV, metrics."""
    bars = d.bars().join(d.industry().select("ts_code", "industry_name"), "ts_code", "left")
    labeled = stage(excess_return_label(compute_factors(bars), d.benchmark()).select(*COLUMNS))
    scored = model_panel(labeled, ["ret_20"]).withColumn("score", F.round("ret_20", 8))
    book = stage(equal_weight_book(stage(scored), 20))
    return rounded(performance_metrics(daily_nav(labeled, book), book), METRICS)


@query("pnl01_research_panel", f"SELECT ts_code, trade_date, {v.rnd('close', 'roe', 'netprofitmargin', 'macro_yoy', 'pe_ttm')}, industry_name, ann_date, end_date FROM v_panel")
def pnl01(d):
    return rounded(d.panel().select("ts_code", "trade_date", "close", "roe", "netprofitmargin", "macro_yoy", "pe_ttm", "industry_name", "ann_date", "end_date"), ["close", "roe", "netprofitmargin", "macro_yoy", "pe_ttm"])


FAC = ("daily_return", "ret_20", "ret_60", "volatility_20", "turnover_20", "ep_ttm")


@query("fac01_core_factors", f"SELECT ts_code, trade_date, {v.rnd(*FAC)} FROM v_factors")
def fac01(d):
    return rounded(compute_factors(d.panel()).select("ts_code", "trade_date", *FAC), FAC)


LAB = ("future_return_20d", "benchmark_daily_return", "benchmark_future_return_20d", "label_excess_return_20d")


@query("fac02_excess_label", f"SELECT ts_code, trade_date, {v.rnd(*LAB)} FROM v_labeled")
def fac02(d):
    return rounded(excess_return_label(d.bars(), d.benchmark()).select("ts_code", "trade_date", *LAB), LAB)


@query("fac03_winsorize_mad", f"SELECT ts_code, trade_date, {v.rnd(*FEATURES)} FROM v_wins")
def fac03(d):
    return rounded(winsorize_mad(d.labeled(), FEATURES).select("ts_code", "trade_date", *FEATURES), FEATURES)


@query("fac03_winsorize_mad_skipping_nulls", f"SELECT ts_code, trade_date, {v.rnd('turnover_20', 'ret_60')} FROM v_wskip")
def fac03b(d):
    return rounded(winsorize_mad(d.labeled(), ["turnover_20", "ret_60"], strict_nulls=False).select("ts_code", "trade_date", "turnover_20", "ret_60"), ["turnover_20", "ret_60"])


v.V["v_wskip"] = v.wins("v_labeled", ("turnover_20", "ret_60"), strict=False)
v.V["v_zind"] = v.zs("v_labeled", ("ret_20", "turnover_20"))
v.V["v_zday"] = v.zs("v_labeled", ("ret_20", "turnover_20"), keys="trade_date", guard="TRUE")


@query("fac04_zscore_by_industry", f"SELECT ts_code, trade_date, {v.rnd('ret_20', 'turnover_20')} FROM v_zind")
def fac04(d):
    return rounded(zscore(d.labeled(), ["ret_20", "turnover_20"], ["trade_date", "industry_name"]).select("ts_code", "trade_date", "ret_20", "turnover_20"), ["ret_20", "turnover_20"])


@query("fac04_zscore_by_date", f"SELECT ts_code, trade_date, {v.rnd('ret_20', 'turnover_20')} FROM v_zday")
def fac04b(d):
    return rounded(zscore(d.labeled(), ["ret_20", "turnover_20"]).select("ts_code", "trade_date", "ret_20", "turnover_20"), ["ret_20", "turnover_20"])


@query("fac05_model_panel", f"SELECT ts_code, trade_date, {v.rnd(*FEATURES)} FROM v_model")
def fac05(d):
    return rounded(model_panel(d.labeled(), list(FEATURES)).select("ts_code", "trade_date", *FEATURES), FEATURES)


@query("fac06_feature_groups", "SELECT * FROM (VALUES (1, 'ep_ttm'), (2, 'roe'), (3, 'netprofitmargin'), (4, 'ret_20'), (5, 'ret_60'), (6, 'volatility_20'), (7, 'turnover_20')) t(pos, feature), (SELECT COUNT(*) AS n FROM v_labeled) n")
def fac06(d):
    """Default groups cut to the columns the panel really holds and that carry a value."""
    panel = d.labeled()
    names = resolve_features(available=panel.columns)
    counts = panel.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("filled")) for c in names])
    filled = counts.select("n", F.posexplode(rows).alias("p", "x")).select("n", "p", "x.feature", "x.filled").where("filled > 0")
    return filled.select(F.row_number().over(W.orderBy("p")).alias("pos"), "feature", "n")


@query("fac07_composite_score", f"SELECT ts_code, trade_date, ROUND({v.mean_of(FEATURES)}, 6) + 0.0 AS score FROM v_model")
def fac07(d):
    return d.model().select("ts_code", "trade_date", r(composite_score(FEATURES)).alias("score"))


v.V["v_eqz"] = v.zs("v_labeled", ("ret_20", "volatility_20", "turnover_20"), keys="trade_date", guard="TRUE")


@query("fac08_equal_weight_score", f"SELECT ts_code, trade_date, CASE WHEN trade_date >= DATE '1996-06-01' THEN ROUND({v.mean_of(('ret_20', 'volatility_20', 'turnover_20'))}, 6) + 0.0 END AS score FROM v_eqz")
def fac08(d):
    return rounded(equal_weight_score(d.labeled(), ["ret_20", "volatility_20", "turnover_20"], "1996-06-01").select("ts_code", "trade_date", "score"), ["score"])


@query("pnl02_benchmark_profile", """SELECT ts_code, ROUND(w / SUM(w) OVER (), 10) AS benchmark_weight
FROM (SELECT ts_code, CASE WHEN ts_code % 5 = 0 THEN NULL ELSE MAX(amount) END AS w FROM v_daily GROUP BY ts_code)""")
def pnl02(d):
    u = d.daily().groupBy(F.col("ts_code").alias("con_code")).agg(F.max("amount").alias("weight"))
    u = u.withColumn("weight", F.when(F.col("con_code") % 5 != 0, F.col("weight")))
    return benchmark_profile(u, d.daily().select("ts_code").distinct()).select("ts_code", F.round("benchmark_weight", 10).alias("benchmark_weight"))


@query("pnl02_profile_of_dated_weights", """SELECT ts_code, ROUND(amount / SUM(amount) OVER (), 10) AS benchmark_weight
FROM v_daily WHERE trade_date = (SELECT MAX(trade_date) FROM v_daily WHERE trade_date <= DATE '1998-06-30')""")
def pnl02b(d):
    u = d.daily().select(F.col("ts_code").alias("con_code"), "trade_date", F.col("amount").alias("weight"))
    return benchmark_profile(u, d.daily(), "1998-06-30").select("ts_code", F.round("benchmark_weight", 10).alias("benchmark_weight"))


@query("pnl03_redate_snapshot", """SELECT DATE '2001-12-31' AS trade_date, CAST(ts_code AS VARCHAR) AS con_code, amount AS weight
FROM v_daily WHERE trade_date = (SELECT MAX(trade_date) FROM v_daily)""")
def pnl03(d):
    last = d.daily().agg(F.max("trade_date")).scalar()
    snap = d.daily().where(F.col("trade_date") == last).select("trade_date", F.col("ts_code").cast("string").alias("con_code"), F.col("amount").alias("weight"))
    return redate_snapshot(snap, "1995-01-01", "2001-12-31")


@query("pnl04_enrich_panel", f"""SELECT b.ts_code, b.trade_date, {v.rnd('close')}, ROUND(m.macro_yoy, 6) + 0.0 AS macro_yoy, ROUND(x.close, 6) AS index_close
FROM v_bars b LEFT JOIN (SELECT trade_date, close AS close FROM v_bench) x ON x.trade_date = b.trade_date
ASOF LEFT JOIN v_macro m ON b.trade_date >= m.trade_date""".replace("ROUND(close, 6)", "ROUND(b.close, 6)"))
def pnl04(d):
    index = d.benchmark().select("trade_date", F.col("close").alias("index_close"))
    panel = d.bars().select("ts_code", "trade_date", "close")
    panel = enrich_panel(panel, daily=[index], low_frequency=[d.macro()])
    again = enrich_panel(panel, daily=[index], low_frequency=[d.macro()])  # present columns are left alone
    return rounded(again, ["close", "macro_yoy", "index_close"])


@query("pnl05_point_in_time_filter", f"""SELECT l.ts_code, l.trade_date, {v.rnd('ret_20')} FROM v_labeled l
SEMI JOIN v_member m ON m.ts_code = l.ts_code AND m.month = DATE_TRUNC('month', l.trade_date)""")
def pnl05(d):
    return rounded(members_only(d.labeled(), d.membership()).select("ts_code", "trade_date", "ret_20"), ["ret_20"])


@query("pnl06_float_cap_weight", """SELECT ts_code, trade_date, ROUND(p / SUM(p) OVER g, 8) AS benchmark_weight FROM (
  SELECT ts_code, trade_date, COALESCE(p, MEDIAN(p) OVER (PARTITION BY trade_date), 1) AS p FROM (
    SELECT ts_code, trade_date, close * vol / NULLIF(turnover_rate, 0) AS p FROM v_bars)) WINDOW g AS (PARTITION BY trade_date)""")
def pnl06(d):
    return float_cap_weights(d.labeled()).select("ts_code", "trade_date", F.round("benchmark_weight", 8).alias("benchmark_weight"))


@query("pnl07_industry_patch", """SELECT COALESCE(m.n_name, p.industry_name, 'UNKNOWN') AS industry_name, COUNT(*) AS n FROM v_panel p
LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0) m ON m.s_suppkey = p.ts_code GROUP BY 1""")
def pnl07(d):
    full = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 3 <> 0")
    patched = patch_industry(d.labeled(), full.select(F.col("s_suppkey").alias("ts_code"), F.col("n_name").alias("industry_name")))
    return patched.groupBy("industry_name").agg(F.count(F.lit(1)).alias("n"))


@query("pnl07_unknown_share", """SELECT ROUND(AVG(CAST(p.industry_name IS NULL AS INT)), 8) AS before, ROUND(AVG(CAST(COALESCE(m.n_name, p.industry_name) IS NULL AS INT)), 8) AS after
FROM v_panel p LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0) m ON m.s_suppkey = p.ts_code""")
def pnl07b(d):
    full = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 3 <> 0")
    return rounded(unknown_share(d.labeled(), full.select(F.col("s_suppkey").alias("ts_code"), F.col("n_name").alias("industry_name"))), ["before", "after"], 8)


# snapshots exist only for odd months; even months carry the previous set forward
v.V["v_snapm"] = "SELECT * FROM v_member WHERE MONTH(month) % 2 = 1"


@query("pnl08_membership_carry_forward", """SELECT s.month, m.ts_code FROM (
  SELECT d.month, MAX(x.month) AS src FROM (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(month) FROM v_snapm), (SELECT MAX(month) FROM v_snapm), INTERVAL 1 MONTH))::DATE AS month) d
  JOIN (SELECT DISTINCT month FROM v_snapm) x ON x.month <= d.month GROUP BY 1) s JOIN v_snapm m ON m.month = s.src""")
def pnl08(d):
    return carry_membership(d.membership().where(F.month("month") % 2 == 1))


@query("pnl09_membership_span", "SELECT ts_code, MIN(month) AS first_month, MAX(month) AS last_month FROM v_member GROUP BY 1")
def pnl09(d):
    return membership_span(d.membership())
