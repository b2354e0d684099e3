"""Joins, aggregates, windows, sorting, set operations and scalar families on the stock panel."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions import columns as C
from alphaloom.operators import factors, joins, reports
from alphaloom.operators.calendar import as_of_calendar, month_spine, period_ends, shift_dates, trading_calendar
from alphaloom.operators.conformal import realised, valid_intervals
from alphaloom.operators.cross_section import group_median, group_transform, min_max_unit
from alphaloom.operators.membership import carry_membership, membership_union
from alphaloom.operators.nav import holding_days
from alphaloom.operators.order_stats import OrderStat, grouped_order_stats, quantile
from alphaloom.operators.positions import snapshots, top_n, turnover
from alphaloom.operators.risk import aligned_windows
from alphaloom.operators.staging import stage
from alphaloom.operators.training import rolling_plan, training_rows
from alphaloom.operators.uncertainty import average_confidence, candidate_filter
from alphaloom.sources import readers
from alphaloom.sources.quality import non_null_share
from checks import views as v
from checks.fixtures import EMBARGO, TRAIN_MONTHS, r, rounded
from checks.q_portfolio import blended, history
from checks.registry import query

LABEL = v.LABEL


def count(name="n"):
    return F.count(F.lit(1)).alias(name)


# --- joins ---------------------------------------------------------------------------------------
v.V["v_basic"] = "SELECT ts_code, trade_date, vol / 100 AS turnover_rate, amount * 2 AS total_mv FROM v_bars WHERE ts_code % 3 <> 0"


@query("jn01_left_join_coalesce", f"SELECT b.ts_code, b.trade_date, ROUND(COALESCE(b.turnover_rate, x.turnover_rate), 6) AS turnover_rate, x.total_mv FROM v_bars b LEFT JOIN v_basic x ON b.ts_code = x.ts_code AND b.trade_date = x.trade_date")
def jn01(d):
    basic = d.bars().where("ts_code % 3 <> 0").select("ts_code", "trade_date", (F.col("vol") / 100).alias("turnover_rate"), (F.col("amount") * 2).alias("total_mv"))
    out = joins.left_join_fill(d.bars().select("ts_code", "trade_date", "turnover_rate"), basic, ["ts_code", "trade_date"])
    return rounded(out, ["turnover_rate"])


@query("jn02_dimension_join", "SELECT ts_code, trade_date, industry_name FROM v_panel")
def jn02(d):
    return d.bars().join(d.industry(), "ts_code", "left").select("ts_code", "trade_date", "industry_name")


@query("jn03_date_series_join", "SELECT b.ts_code, b.trade_date, ROUND(x.close, 4) AS index_close FROM v_bars b LEFT JOIN v_bench x ON b.trade_date = x.trade_date AND x.trade_date < DATE '2000-01-01'")
def jn03(d):
    index = d.benchmark().where("trade_date < DATE'2000-01-01'").select("trade_date", F.col("close").alias("index_close"))
    return rounded(joins.join_date_series(d.bars(), index).select("ts_code", "trade_date", "index_close"), ["index_close"], 4)


@query("jn04_keyed_asof", f"SELECT ts_code, trade_date, ann_date, end_date, {v.rnd('roe')} FROM v_asof")
def jn04(d):
    return rounded(joins.asof_join(d.bars(), d.financials()).select("ts_code", "trade_date", "ann_date", "end_date", "roe"), ["roe"])


@query("jn04_keyed_asof_many_rows_per_day", "SELECT l_suppkey AS ts_code, f.end_date, COUNT(*) AS n FROM lineitem l ASOF LEFT JOIN v_find f ON l.l_suppkey = f.ts_code AND CAST(l.l_shipdate AS DATE) >= f.ann_date GROUP BY 1, 2")
def jn04b(d):
    """The left side has many rows per code and day, so it is matched on its distinct days."""
    li = d.table("lineitem").select(F.col("l_suppkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("trade_date"))
    return joins.asof_join(li, d.financials(), left_unique=False).groupBy("ts_code", "end_date").agg(count())


@query("jn05_unkeyed_asof", "SELECT b.ts_code, b.trade_date, ROUND(m.macro_yoy, 6) + 0.0 AS macro_yoy FROM v_bars b ASOF LEFT JOIN v_macro m ON b.trade_date >= m.trade_date")
def jn05(d):
    return rounded(joins.asof_series(d.bars(), d.macro()).select("ts_code", "trade_date", "macro_yoy"), ["macro_yoy"])


PARTS = {"profit": 2, "growth": 3, "operation": 5, "cash": 7, "dupont": 11}
for k, m in PARTS.items():
    v.V[f"v_{k}"] = f"SELECT ts_code, ann_date, end_date, roe * {m} AS {k} FROM v_fin WHERE ts_code % {m} <> 0"


@query("jn06_full_outer_chain", "SELECT ts_code, ann_date, end_date, " + ", ".join(f"ROUND({k}, 6) AS {k}" for k in PARTS) + " FROM v_profit " + " ".join(f"FULL JOIN v_{k} USING (ts_code, ann_date, end_date)" for k in list(PARTS)[1:]))
def jn06(d):
    frames = [d.financials().where(F.col("ts_code") % m != 0).select("ts_code", "ann_date", "end_date", (F.col("roe") * m).alias(k)) for k, m in PARTS.items()]
    return rounded(joins.full_outer_chain(frames, ["ts_code", "ann_date", "end_date"]), list(PARTS))


@query("jn07_membership_semi_join", "SELECT b.ts_code, b.trade_date FROM v_bars b SEMI JOIN v_member m ON m.ts_code = b.ts_code AND m.month = DATE_TRUNC('month', b.trade_date)")
def jn07(d):
    return joins.members_only(d.bars(), d.membership()).select("ts_code", "trade_date")


@query("jn08_code_and_date_semi_join", "SELECT ts_code, trade_date FROM v_bars WHERE trade_date IN (SELECT trade_date FROM v_ends) AND ts_code IN (SELECT ts_code FROM v_industry WHERE industry_name = 'ASIA')")
def jn08(d):
    codes = d.industry().where("industry_name = 'ASIA'").select("ts_code")
    rows = d.bars().join(F.broadcast(period_ends(d.bars()).select("trade_date")), "trade_date", "left_semi")
    return rows.join(codes, "ts_code", "left_semi").select("ts_code", "trade_date")


@query("jn09_former_members", "SELECT DISTINCT ts_code FROM v_member WHERE ts_code NOT IN (SELECT ts_code FROM v_member WHERE month = (SELECT MAX(month) FROM v_member))")
def jn09(d):
    last = d.membership().agg(F.max("month")).scalar()
    return joins.former_members(d.membership(), d.membership().where(F.col("month") == last))


@query("jn10_lookup_with_default", "SELECT b.ts_code, COALESCE(x.industry_name, 'UNKNOWN') AS industry_name, COUNT(*) AS n FROM v_bars b LEFT JOIN (SELECT * FROM v_industry WHERE ts_code % 4 <> 1) x USING (ts_code) GROUP BY 1, 2")
def jn10(d):
    return joins.lookup(d.bars(), d.industry().where("ts_code % 4 <> 1"), "ts_code", "industry_name", "UNKNOWN").groupBy("ts_code", "industry_name").agg(count())


@query("jn11_attach_predictions", "SELECT m.ts_code, m.trade_date, ROUND(c.ml_score, 6) + 0.0 AS score, ROUND(c.confidence, 6) + 0.0 AS confidence FROM v_model m LEFT JOIN v_conf c ON m.ts_code = c.ts_code AND m.trade_date = c.trade_date")
def jn11(d):
    out = joins.attach_predictions(d.model(), d.conformal(), ["ml_score", "confidence"])
    return rounded(out.select("ts_code", "trade_date", "score", "confidence"), ["score", "confidence"])


@query("jn12_book_changes", "SELECT rebalance_date, ROUND(turnover, 6) AS turnover FROM v_turn")
def jn12(d):
    """Consecutive books of the composite top 20, with entries and exits on either side."""
    return rounded(turnover(top_n(snapshots(d.scored()), 20)), ["turnover"])


@query("jn13_blend_full_join", f"SELECT rebalance_date, ts_code, {v.rnd('weight', digits=5)} FROM v_blend")
def jn13(d):
    return rounded(blended(d).select("rebalance_date", "ts_code", "weight"), ["weight"], 5)


@query("jn14_dense_alignment", """SELECT c.rebalance_date, c.ts_code, COUNT(*) AS n, COUNT(*) FILTER (WHERE h.x IS NULL OR h.x = 0) AS zeros, ROUND(SUM(COALESCE(h.x, 0)), 6) + 0.0 AS total
FROM (SELECT DISTINCT rebalance_date, ts_code FROM v_hist) c JOIN (SELECT DISTINCT rebalance_date, trade_date FROM v_hist) k ON k.rebalance_date = c.rebalance_date
LEFT JOIN v_hist h ON h.rebalance_date = c.rebalance_date AND h.ts_code = c.ts_code AND h.trade_date = k.trade_date GROUP BY 1, 2""")
def jn14(d):
    """The windows that the risk model reads, zero-filled."""
    windows = history(d)[0]
    dense = aligned_windows(windows, windows)
    dense = dense.groupBy("rebalance_date", "ts_code").agg(count(), F.count_if(F.col("x") == 0).alias("zeros"), F.sum("x").alias("total"))
    return rounded(dense, ["total"])


@query("jn15_date_offset", "SELECT a.trade_date, b.trade_date AS realized_date FROM v_cal a LEFT JOIN v_cal b ON b.idx = a.idx + 20")
def jn15(d):
    return shift_dates(trading_calendar(d.bars()), 20, "realized_date").drop("idx")


@query("jn16_training_range_join", f"SELECT w.window_id, DATE_TRUNC('month', m.trade_date)::DATE AS month, COUNT(*) AS n, ROUND(SUM(m.{LABEL}), 5) + 0.0 AS label_sum FROM v_model m JOIN v_cal c ON m.trade_date = c.trade_date JOIN v_roll w ON c.idx BETWEEN w.first_idx AND w.last_idx WHERE m.{LABEL} IS NOT NULL GROUP BY ALL")
def jn16(d):
    rows = training_rows(d.model(), rolling_plan(d.model(), TRAIN_MONTHS))
    return rows.groupBy("window_id", F.date_trunc("month", "trade_date").cast("date").alias("month")).agg(count(), r(F.sum(LABEL), 5).alias("label_sum"))


@query("jn17_effective_weights", "SELECT c.trade_date, (SELECT MAX(b.rebalance_date) FROM v_book b WHERE b.rebalance_date < c.trade_date) AS rebalance_date FROM v_cal c WHERE c.trade_date > (SELECT MIN(rebalance_date) FROM v_book)")
def jn17(d):
    return holding_days(d.book(), trading_calendar(d.scored()))


@query("jn18_realised_history", "SELECT e.trade_date, COUNT(r.hit) AS n, CAST(COALESCE(SUM(r.hit), 0) AS BIGINT) AS hits FROM v_ends e LEFT JOIN v_real r ON r.realized_date <= e.trade_date GROUP BY 1")
def jn18(d):
    from alphaloom.operators.conformal import _history

    known = realised(valid_intervals(d.conformal()), trading_calendar(d.model())).where("realized_date IS NOT NULL")
    h = _history(known, {"n": F.count(F.lit(1)), "hits": F.sum(F.col("covered").cast("long"))}, period_ends(d.model()).select("trade_date"))
    return h.select("trade_date", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))


# --- aggregates ----------------------------------------------------------------------------------


@query("agg01_group_aggregate", "SELECT rebalance_date, ROUND(ARG_MIN(score, ts_code), 6) + 0.0 AS first_score, ROUND(AVG(score), 6) + 0.0 AS mean_score, ROUND(MAX(weight), 6) AS max_weight FROM v_book GROUP BY 1")
def agg01(d):
    return d.book().groupBy("rebalance_date").agg(r(F.min_by("score", "ts_code")).alias("first_score"), r(F.avg("score")).alias("mean_score"), r(F.max("weight")).alias("max_weight"))


@query("agg02_global_aggregates", "SELECT ROUND(AVG(ret_20), 6) AS mean, ROUND(STDDEV_SAMP(ret_20), 6) AS std, ROUND(MIN(ret_20), 6) AS min, ROUND(MAX(ret_20), 6) AS max, COUNT(ret_20) AS n FROM v_labeled")
def agg02(d):
    x = F.col("ret_20")
    return d.labeled().agg(r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), r(F.min(x)).alias("min"), r(F.max(x)).alias("max"), F.count(x).alias("n"))


@query("agg03_last_date_per_period", "SELECT 'month' AS period, MAX(trade_date) AS trade_date FROM v_cal GROUP BY DATE_TRUNC('month', trade_date) UNION ALL SELECT 'week', MAX(trade_date) FROM v_cal GROUP BY DATE_TRUNC('week', trade_date)")
def agg03(d):
    return reports.union_labelled([(p, period_ends(d.bars(), p).select("trade_date")) for p in ("month", "week")], "period")


@query("agg04_distinct_counts", "SELECT trade_date, COUNT(DISTINCT ts_code) AS codes FROM v_bars GROUP BY 1 UNION ALL SELECT NULL, COUNT(DISTINCT ts_code) FROM v_bars")
def agg04(d):
    per_day = d.bars().groupBy("trade_date").agg(F.countDistinct("ts_code").alias("codes"))
    return per_day.unionByName(d.bars().agg(F.countDistinct("ts_code").alias("codes")).withColumn("trade_date", F.lit(None).cast("date")))


@query("agg05_compounding", "SELECT DATE_TRUNC('month', trade_date)::DATE AS month, ROUND(PRODUCT(1 + portfolio_return) - 1, 6) + 0.0 AS portfolio_return FROM v_nav GROUP BY 1")
def agg05(d):
    return d.nav().groupBy(F.date_trunc("month", "trade_date").cast("date").alias("month")).agg(r(C.compound(F.col("portfolio_return"))).alias("portfolio_return"))


@query("agg06_conditional_compounding", "SELECT ROUND(PRODUCT(1 + portfolio_return) FILTER (benchmark_return > 0) - 1, 6) AS up, ROUND(PRODUCT(1 + portfolio_return) FILTER (benchmark_return < 0) - 1, 6) AS down FROM v_nav")
def agg06(d):
    g, b = 1.0 + F.col("portfolio_return"), F.col("benchmark_return")
    return d.nav().agg(r(F.product(F.when(b > 0, g)) - 1.0).alias("up"), r(F.product(F.when(b < 0, g)) - 1.0).alias("down"))


@query("agg07_grouping_sets", """SELECT CASE WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(industry_name) = 0 THEN 'industry' ELSE 'overall' END AS scope,
  COALESCE(month, industry_name, 'all') AS bucket, COUNT(*) AS n, ROUND(AVG(vol), 6) AS mean_vol
FROM (SELECT STRFTIME(trade_date, '%Y-%m') AS month, COALESCE(industry_name, 'UNKNOWN') AS industry_name, vol FROM v_panel) GROUP BY GROUPING SETS ((), (month), (industry_name))""")
def agg07(d):
    rows = d.panel().select(F.date_format("trade_date", "yyyy-MM").alias("month"), F.coalesce("industry_name", F.lit("UNKNOWN")).alias("industry_name"), "vol")
    out = rows.groupingSets([[], [F.col("month")], [F.col("industry_name")]], "month", "industry_name").agg(F.grouping_id().alias("g"), count(), r(F.avg("vol")).alias("mean_vol"))
    scope = F.when(F.col("g") == 1, "month").when(F.col("g") == 2, "industry").otherwise("overall")
    return out.select(scope.alias("scope"), F.coalesce("month", "industry_name", F.lit("all")).alias("bucket"), "n", "mean_vol")


@query("agg08_quantile_buckets", """SELECT CASE WHEN ret_20 <= (SELECT QUANTILE_CONT(ret_20, 0.3) FROM v_labeled) THEN 'low' WHEN ret_20 >= (SELECT QUANTILE_CONT(ret_20, 0.7) FROM v_labeled) THEN 'high' ELSE 'mid' END AS bucket,
  COUNT(*) AS n, ROUND(AVG(label_excess_return_20d), 6) AS mean_label FROM v_labeled WHERE ret_20 IS NOT NULL GROUP BY 1""")
def agg08(d):
    rows = d.labeled().where("ret_20 IS NOT NULL")
    cuts = stage(grouped_order_stats(rows, [], {"lo": quantile(F.col("ret_20"), 0.3), "hi": quantile(F.col("ret_20"), 0.7)}))
    lo, hi = cuts.select("lo").scalar(), cuts.select("hi").scalar()
    bucket = F.when(F.col("ret_20") <= lo, "low").when(F.col("ret_20") >= hi, "high").otherwise("mid")
    return rows.groupBy(bucket.alias("bucket")).agg(count(), r(F.avg(LABEL)).alias("mean_label"))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("agg09_pivot", "SELECT YEAR(trade_date) AS year, " + ", ".join(f"ROUND(AVG(close) FILTER (industry_name = '{x}'), 4) AS \"{x}\"" for x in REGIONS) + " FROM v_panel GROUP BY 1")
def agg09(d):
    wide = d.panel().groupBy(F.year("trade_date").alias("year")).pivot("industry_name", REGIONS).agg(F.avg("close"))
    return rounded(wide, REGIONS, 4)


WIDE = ("ret_20", "volatility_20", "turnover_20")
v.V["v_wide"] = "SELECT trade_date, " + ", ".join(f"AVG(ABS({c})) AS {c}" for c in WIDE) + " FROM v_labeled GROUP BY 1"


@query("agg10_unpivot_means", " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(AVG({c}), 6) AS mean FROM v_wide" for c in WIDE))
def agg10(d):
    wide = d.labeled().groupBy("trade_date").agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in WIDE])
    return rounded(reports.unpivot_importance(wide, WIDE), ["mean"])


v.V["v_imp"] = " UNION ALL ".join(f"SELECT trade_date, '{c}' AS feature, {c} AS importance FROM v_wide" for c in WIDE)


@query("agg11_mean_and_std_top", "SELECT feature, ROUND(AVG(importance), 6) AS mean, ROUND(COALESCE(STDDEV_SAMP(importance), 0), 6) AS std FROM v_imp GROUP BY 1 ORDER BY 2 DESC LIMIT 15")
def agg11(d):
    wide = d.labeled().groupBy("trade_date").agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in WIDE])
    return rounded(reports.importance_summary(wide.unpivot("trade_date", list(WIDE), "feature", "importance")), ["mean", "std"])


@query("agg12_correlation", "SELECT industry_name, ROUND(CASE WHEN COUNT(*) >= 200 THEN COALESCE(CORR(ret_20, label_excess_return_20d), 0) ELSE 0 END, 6) + 0.0 AS r FROM v_labeled WHERE ret_20 IS NOT NULL AND label_excess_return_20d IS NOT NULL GROUP BY 1")
def agg12(d):
    rows = d.labeled().where(f"ret_20 IS NOT NULL AND {LABEL} IS NOT NULL")
    c = F.when(F.count(F.lit(1)) >= 200, F.coalesce(F.corr("ret_20", LABEL), F.lit(0.0))).otherwise(0.0)
    return rows.groupBy("industry_name").agg(r(c).alias("r"))


@query("agg13_interpolated_quantiles", "SELECT industry_name, ROUND(QUANTILE_CONT(ret_20, 0.3), 6) + 0.0 AS q30, ROUND(QUANTILE_CONT(ret_20, 0.7), 6) + 0.0 AS q70 FROM v_labeled WHERE industry_name IS NOT NULL GROUP BY 1")
def agg13(d):
    q = grouped_order_stats(d.labeled(), ["industry_name"], {"q30": quantile(F.col("ret_20"), 0.3), "q70": quantile(F.col("ret_20"), 0.7)})
    return rounded(q.select("industry_name", "q30", "q70"), ["q30", "q70"])


@query("agg14_conformal_rank", "SELECT industry_name, n_calib AS n, ROUND(q, 6) + 0.0 AS q FROM (" + v.conf_q("(SELECT industry_name, ABS(ret_20) AS score FROM v_labeled WHERE ret_20 IS NOT NULL AND industry_name IS NOT NULL)", 0.1, "industry_name") + ")")
def agg14(d):
    from alphaloom.operators.conformal import conformal_rank

    q = grouped_order_stats(d.labeled(), ["industry_name"], {"q": OrderStat(F.abs(F.col("ret_20")), 0.9, conformal_rank(0.1))})
    return q.select("industry_name", F.col("q_n").alias("n"), r("q").alias("q"))


@query("agg15_weighted_average", "SELECT rebalance_date, ROUND(SUM(score * (weight + 1e-12)) / SUM(weight + 1e-12), 6) + 0.0 AS avg_confidence FROM v_book GROUP BY 1")
def agg15(d):
    return rounded(average_confidence(d.book().withColumn("confidence", F.col("score"))), ["avg_confidence"])


@query("agg16_shares", "SELECT ROUND(AVG(CAST(turnover_rate IS NOT NULL AS INT)), 8) AS filled, ROUND(AVG(CAST(industry_name IS NULL AS INT)), 8) AS without_industry FROM v_panel")
def agg16(d):
    return d.panel().agg(F.round(non_null_share("turnover_rate"), 8).alias("filled"), F.round(F.avg(F.col("industry_name").isNull().cast("int")), 8).alias("without_industry"))


@query("agg17_variation", "SELECT ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_SAMP(x), 6) AS std, ROUND(STDDEV_SAMP(x) / AVG(x), 6) AS cv, ROUND(MIN(x), 6) AS min, ROUND(MAX(x), 6) AS max FROM (SELECT ts_code, AVG(vol) AS x FROM v_bars GROUP BY 1)")
def agg17(d):
    s = reports.seed_statistics(d.bars().groupBy("ts_code").agg(F.avg("vol").alias("x")), "x")
    return rounded(s, ["mean", "std", "cv", "min", "max"])


@query("agg18_sample_covariance_terms", "SELECT rebalance_date, n_days, p, ROUND(mu * 1e6, 5) AS mean_variance FROM v_shrink")
def agg18(d):
    return history(d)[1].select("rebalance_date", "n_days", "p", r(F.col("mu") * 1e6, 5).alias("mean_variance"))


# --- windows -------------------------------------------------------------------------------------


@query("win01_pct_change", "SELECT ts_code, trade_date, " + ", ".join(f"ROUND(close / LAG(close, {n}) OVER w - 1, 6) + 0.0 AS r{n}" for n in (1, 20, 60)) + " FROM v_bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)")
def win01(d):
    w = factors.by_security()
    return d.bars().select("ts_code", "trade_date", *[r(factors.pct_change(F.col("close"), n, w)).alias(f"r{n}") for n in (1, 20, 60)])


@query("win01_pct_change_over_gaps", """SELECT ts_code, trade_date, ROUND(f / LAG(f) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1, 6) + 0.0 AS daily_return FROM (
  SELECT ts_code, trade_date, LAST_VALUE(CASE WHEN vol % 5 <> 0 THEN close END IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM v_bars)""")
def win01b(d):
    gaps = d.bars().select("ts_code", "trade_date", F.when(F.col("vol") % 5 != 0, F.col("close")).alias("close"))
    return rounded(factors.compute_factors(gaps).select("ts_code", "trade_date", "daily_return"), ["daily_return"])


@query("win02_forward_return", "SELECT ts_code, trade_date, ROUND(LEAD(close, 20) OVER w / close - 1, 6) + 0.0 AS forward FROM v_bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)")
def win02(d):
    return d.bars().select("ts_code", "trade_date", r(factors.forward_return(F.col("close"), 20, factors.by_security())).alias("forward"))


ROLL = "WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("win03_rolling_std", f"SELECT ts_code, trade_date, CASE WHEN COUNT(turnover_rate) OVER w = 10 THEN ROUND(STDDEV_SAMP(turnover_rate) OVER w * SQRT(10), 6) + 0.0 END AS s FROM v_bars {ROLL}")
def win03(d):
    t = F.col("turnover_rate")
    return d.bars().select("ts_code", "trade_date", r(factors.full_window(F.stddev_samp(t), t, factors.by_security(), 10) * F.sqrt(F.lit(10.0))).alias("s"))


@query("win04_rolling_mean", f"SELECT ts_code, trade_date, CASE WHEN COUNT(turnover_rate) OVER w = 10 THEN ROUND(AVG(turnover_rate) OVER w, 6) END AS m FROM v_bars {ROLL}")
def win04(d):
    t = F.col("turnover_rate")
    return d.bars().select("ts_code", "trade_date", r(factors.full_window(F.avg(t), t, factors.by_security(), 10)).alias("m"))


@query("win05_group_transform", "SELECT ts_code, trade_date, ROUND(AVG(vol) OVER d, 6) AS mean, ROUND(STDDEV_SAMP(vol) OVER d, 6) AS std, ROUND(SUM(vol) OVER d, 2) AS total, ROUND(MEDIAN(vol) OVER d, 6) AS med FROM v_bars WINDOW d AS (PARTITION BY trade_date)")
def win05(d):
    aggs = {"mean": F.avg("vol"), "std": F.stddev_samp("vol"), "total": F.sum("vol")}
    out = group_transform(d.labeled().select("ts_code", "trade_date", "vol"), ["trade_date"], aggs, calendar_keyed=True)
    out = group_median(out, ["trade_date"], {"med": F.col("vol")}, calendar_keyed=True).drop("vol")
    return rounded(rounded(out, ["mean", "std", "med"]), ["total"], 2)


@query("win06_running_max_drawdown", "SELECT trade_date, ROUND(MAX(portfolio_nav) OVER o, 6) AS peak, ROUND(portfolio_nav / MAX(portfolio_nav) OVER o - 1, 6) + 0.0 AS drawdown FROM v_nav WINDOW o AS (ORDER BY trade_date)")
def win06(d):
    w = W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    peak = F.max("portfolio_nav").over(w)
    return d.nav().select("trade_date", r(peak).alias("peak"), r(F.col("portfolio_nav") / peak - 1).alias("drawdown"))


@query("win07_running_product", "SELECT trade_date, ROUND(PRODUCT(1 + benchmark_return) OVER (ORDER BY trade_date), 6) AS nav FROM v_nav")
def win07(d):
    w = W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return d.nav().select("trade_date", r(F.product(1.0 + F.col("benchmark_return")).over(w)).alias("nav"))


@query("win08_previous_value", "SELECT trade_date, ROUND(COALESCE(LAG(portfolio_nav) OVER (ORDER BY trade_date), 1), 6) AS previous FROM v_nav")
def win08(d):
    return d.nav().select("trade_date", r(F.lag("portfolio_nav", 1, 1.0).over(W.orderBy("trade_date"))).alias("previous"))


@query("win09_calendar_ordinal", "SELECT trade_date, idx FROM v_cal")
def win09(d):
    return trading_calendar(d.bars())


@query("win10_first_value_rebase", "SELECT trade_date, ROUND(close / FIRST_VALUE(close) OVER (ORDER BY trade_date), 6) AS rebased FROM v_bench")
def win10(d):
    w = W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    return d.benchmark().select("trade_date", r(F.col("close") / F.first("close").over(w)).alias("rebased"))


@query("win11_carry_sets_forward", """SELECT s.month, COUNT(*) AS members FROM (
  SELECT d.month, MAX(x.month) AS src FROM (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(month) FROM v_quarterly), DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month) d
  JOIN (SELECT DISTINCT month FROM v_quarterly) x ON x.month <= d.month GROUP BY 1) s JOIN v_quarterly m ON m.month = s.src GROUP BY 1""")
def win11(d):
    quarterly = d.membership().where(F.month("month").isin(3, 6, 9, 12))
    return carry_membership(quarterly, last="2001-12-01").groupBy("month").agg(count("members"))


v.V["v_quarterly"] = "SELECT * FROM v_member WHERE MONTH(month) IN (3, 6, 9, 12)"


@query("win12_last_dates_before_anchor", "SELECT rebalance_date, COUNT(DISTINCT trade_date) AS n_days, MIN(trade_date) AS first_day, MAX(trade_date) AS last_day, COUNT(*) AS n FROM v_hist GROUP BY 1")
def win12(d):
    h = history(d)[0]
    return h.groupBy("rebalance_date").agg(F.countDistinct("trade_date").alias("n_days"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), count())


@query("win13_expanding_statistics", """SELECT k.trade_date, COUNT(l.ret_20) AS n, ROUND(AVG(l.ret_20), 6) + 0.0 AS mean FROM v_ends k LEFT JOIN v_labeled l ON l.trade_date <= k.trade_date GROUP BY 1""")
def win13(d):
    per_day = d.labeled().groupBy("trade_date").agg(F.count("ret_20").alias("n"), F.sum("ret_20").alias("s"))
    run = W.orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    sums = per_day.select("trade_date", F.sum("n").over(run).alias("n"), F.sum("s").over(run).alias("s"))
    out = as_of_calendar(period_ends(d.labeled()).select("trade_date"), sums)
    return out.select("trade_date", "n", r(F.try_divide("s", "n")).alias("mean"))


@query("win14_top_n_per_date", "SELECT trade_date, ts_code, vol FROM v_bars QUALIFY ROW_NUMBER() OVER (PARTITION BY trade_date ORDER BY vol DESC, ts_code) <= 3")
def win14(d):
    rank = F.row_number().over(W.partitionBy("trade_date").orderBy(F.col("vol").desc(), "ts_code"))
    return d.bars().select("trade_date", "ts_code", "vol", rank.alias("rk")).where("rk <= 3").drop("rk")


# --- sorting and sets ----------------------------------------------------------------------------


@query("srt01_multi_key_sort", "SELECT ts_code, trade_date, vol FROM v_bars ORDER BY ts_code, trade_date")
def srt01(d):
    return d.bars().select("ts_code", "trade_date", "vol").orderBy("ts_code", "trade_date")


@query("srt02_first_k_codes", "SELECT DISTINCT ts_code FROM v_member ORDER BY ts_code LIMIT 5")
def srt02(d):
    return readers.research_universe(d.membership().select(F.col("ts_code").alias("con_code")), 5)


@query("srt03_top_fraction", """SELECT trade_date, ts_code, confidence FROM (SELECT trade_date, ts_code, vol AS confidence FROM v_bars)
QUALIFY ROW_NUMBER() OVER (PARTITION BY trade_date ORDER BY confidence DESC, ts_code) <= GREATEST(CEIL(COUNT(*) OVER (PARTITION BY trade_date) * CAST(0.4 AS DOUBLE)), LEAST(4, COUNT(*) OVER (PARTITION BY trade_date)))""")
def srt03(d):
    rows = d.daily().select(F.col("trade_date").alias("rebalance_date"), "ts_code", F.col("vol").alias("confidence"))
    return candidate_filter(rows, 0.4, 4).withColumnRenamed("rebalance_date", "trade_date")


@query("srt04_custom_bucket_order", "SELECT CASE WHEN vol >= 60 THEN 'top_30' WHEN vol >= 30 THEN 'mid_40' ELSE 'bottom_30' END AS bucket, CASE WHEN vol >= 60 THEN 0 WHEN vol >= 30 THEN 1 ELSE 2 END AS pos, COUNT(*) AS n FROM v_bars GROUP BY ALL")
def srt04(d):
    from alphaloom.operators.conformal import bucket_order

    b = F.when(F.col("vol") >= 60, "top_30").when(F.col("vol") >= 30, "mid_40").otherwise("bottom_30")
    out = d.bars().groupBy(b.alias("bucket")).agg(count()).withColumn("pos", bucket_order(F.col("bucket")))
    return reports.order_by_rank(out, F.col("pos"))


@query("set01_union_with_label", "SELECT 'bars' AS source, COUNT(*) AS n, CAST(NULL AS BIGINT) AS reports FROM v_bars UNION ALL SELECT 'financials', COUNT(*), COUNT(roe) FROM v_fin")
def set01(d):
    return reports.union_labelled([("bars", d.bars().agg(count())), ("financials", d.financials().agg(count(), F.count("roe").alias("reports")))], "source")


@query("set02_membership_union", "SELECT DISTINCT ts_code FROM v_member")
def set02(d):
    return membership_union(d.membership())


@query("set03_set_difference", "SELECT ts_code FROM v_member WHERE month = DATE '1997-06-01' EXCEPT SELECT ts_code FROM v_member WHERE month = DATE '1998-06-01'")
def set03(d):
    m = d.membership()
    return m.where("month = DATE'1997-06-01'").select("ts_code").subtract(m.where("month = DATE'1998-06-01'").select("ts_code"))


@query("set04_intersection", "SELECT ts_code, trade_date FROM v_book JOIN v_conf USING (ts_code) WHERE rebalance_date = trade_date")
def set04(d):
    return d.book().select("ts_code", F.col("rebalance_date").alias("trade_date")).intersect(d.conformal().select("ts_code", "trade_date"))


# --- scalar families -----------------------------------------------------------------------------


@query("fn01_strings", "SELECT s_suppkey AS id, UPPER(SPLIT_PART(s_name, '#', 1)) AS head, LPAD(RIGHT(s_name, 4), 6, '0') AS padded, SUBSTRING(s_name, 1, 6) AS six, STARTS_WITH(s_name, 'Supp') AS starts, CONTAINS(s_name, '#0000') AS has, TRIM(' ' || LOWER(s_name) || ' ') AS trimmed, REGEXP_REPLACE(s_name, '^Supplier#0*', '') AS bare FROM supplier")
def fn01(d):
    n = F.col("s_name")
    return d.table("supplier").select(
        F.col("s_suppkey").alias("id"), F.upper(F.get(F.split(n, "#"), F.lit(0))).alias("head"), C.zero_pad_code(F.right(n, F.lit(4))).alias("padded"), F.substring(n, 1, 6).alias("six"),
        F.startswith(n, F.lit("Supp")).alias("starts"), F.contains(n, F.lit("#0000")).alias("has"), F.trim(F.concat(F.lit(" "), F.lower(n), F.lit(" "))).alias("trimmed"), F.regexp_replace(n, "^Supplier#0*", "").alias("bare"),
    )


@query("fn02_dates", "SELECT trade_date, STRFTIME(trade_date, '%Y%m') AS ym, QUARTER(trade_date) AS quarter, YEAR(trade_date) - 1 AS last_year, DATE_TRUNC('month', trade_date)::DATE AS month FROM v_cal UNION ALL SELECT NULL, NULL, NULL, NULL, UNNEST(GENERATE_SERIES(DATE_TRUNC('month', (SELECT MIN(trade_date) FROM v_cal))::DATE, (SELECT MAX(trade_date) FROM v_cal), INTERVAL 1 MONTH))::DATE")
def fn02(d):
    t = F.col("trade_date")
    days = d.bars().select("trade_date").distinct().select("trade_date", F.date_format(t, "yyyyMM").alias("ym"), F.quarter(t).alias("quarter"), (F.year(t) - 1).alias("last_year"), F.date_trunc("month", t).cast("date").alias("month"))
    spine = d.bars().agg(F.min(t).alias("a"), F.max(t).alias("b")).select(month_spine(F.col("a"), F.col("b")))
    return days.unionByName(spine, allowMissingColumns=True)


@query("fn03_math", "SELECT ts_code, trade_date, ROUND(LN(close), 6) AS ln, ROUND(SQRT(ABS(-close)), 6) AS root, ROUND(EXP(-vol / 100), 6) AS e, ROUND(POW(vol, 0.5), 6) AS p, CAST(CEIL(close / 10) AS BIGINT) AS c, ROUND(GREATEST(-vol, -20), 6) + 0.0 AS g, ABS(vol - 25) < 1e-8 AS near FROM v_bars")
def fn03(d):
    x, y = F.col("close"), F.col("vol")
    return d.bars().select(
        "ts_code", "trade_date", r(F.log(x)).alias("ln"), r(F.sqrt(F.abs(-x))).alias("root"), r(F.exp(-y / 100)).alias("e"), r(F.pow(y, F.lit(0.5))).alias("p"), F.ceil(x / 10).alias("c"),
        r(F.greatest(-y, F.lit(-20.0))).alias("g"), C.near_zero(y - 25).alias("near"),
    )


@query("fn04_row_mean", f"SELECT ts_code, trade_date, ROUND({v.mean_of(WIDE, ())}, 6) + 0.0 AS m FROM v_labeled")
def fn04(d):
    return d.labeled().select("ts_code", "trade_date", r(C.row_mean([F.col(c) for c in WIDE])).alias("m"))


@query("fn05_min_max_scaling", "SELECT ts_code, trade_date, ROUND(CASE WHEN MAX(vol) OVER d - MIN(vol) OVER d <= 1e-6 THEN 1 ELSE (vol - MIN(vol) OVER d) / (MAX(vol) OVER d - MIN(vol) OVER d + 1e-6) END, 6) + 0.0 AS unit FROM v_bars WINDOW d AS (PARTITION BY trade_date)")
def fn05(d):
    return rounded(min_max_unit(d.bars().select("ts_code", "trade_date", "vol"), "vol", "unit").drop("vol"), ["unit"])


@query("fn06_non_finite_to_zero", "SELECT ts_code, trade_date, ROUND(COALESCE(close / NULLIF(vol - 25, 0), 0), 6) + 0.0 AS x FROM v_bars")
def fn06(d):
    return d.bars().select("ts_code", "trade_date", r(F.coalesce(C.null_if_nan(F.try_divide(F.col("close"), F.col("vol") - 25)), F.lit(0.0))).alias("x"))
