"""The public runs end to end on text codes, from raw feeds to metrics."""

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import risk
from alphaloom.operators.conformal import conformal_predictions
from alphaloom.operators.cross_section import composite_score
from alphaloom.operators.positions import prepare_snapshot, snapshots
from alphaloom.operators.staging import stage
from alphaloom.operators.uncertainty import candidate_filter
from alphaloom.plans import backtest, panels, studies
from alphaloom.sources import conform
from checks.fixtures import data
from checks.q_sources import raw_bars, raw_code, raw_financials, raw_members, raw_valuation


@pytest.fixture(scope="module")
def feeds(spark):
    d = data(spark, "/root/testdata/sf0.01")
    members = conform.constituents(raw_members(d)).select(F.col("ts_code").alias("con_code"), "weight")
    industry = conform.constituents(raw_members(d)).select("ts_code", F.col("stock_name").alias("industry_name"))
    flow = conform.northbound_flow(
        d.daily().groupBy("trade_date").agg(F.sum("amount").alias("sh_amount")), d.daily().groupBy("trade_date").agg(F.sum("vol").alias("sz_amount")), "1995-01-01", "2001-12-31"
    )
    macro = [d.macro().withColumnRenamed("macro_yoy", "m2_yoy"), d.macro().withColumnRenamed("macro_yoy", "cn_spread_10y_2y")]
    bench = d.benchmark()
    return panels.Feeds(conform.daily_bars(raw_bars(d)), conform.valuation(raw_valuation(d)), conform.financials(raw_financials(d)), industry, members, bench, flow, macro), d


@pytest.fixture(scope="module")
def panel(feeds):
    return stage(panels.factor_panel(feeds[0]))


def test_factor_panel_has_every_column_once(panel, feeds):
    wanted = {"roe", "netprofitmargin", "ep_ttm", "ret_20", "benchmark_weight", "northbound_net_inflow", "m2_yoy", "cn_spread_10y_2y", "label_excess_return_20d"}
    assert wanted <= set(panel.columns) and len(set(panel.columns)) == len(panel.columns)
    assert panel.count() == feeds[1].bars().count()


def test_equal_weight_run_and_window(panel):
    scored = stage(panel.withColumn("score", F.round(composite_score(["ret_20", "volatility_20", "roe", "ep_ttm"]), 8)))
    run = backtest.equal_weight(scored, 10)
    full, cut = run.metrics.first(), run.window("1998-01-01", "1999-12-31").metrics.first()
    assert full["information_ratio"] is not None and cut["annual_turnover"] > 0


def test_conformal_to_tilted_books(panel):
    pred = stage(conformal_predictions(panel, ["ret_20", "roe"], min_train_rows=100).predictions)
    assert pred.where("NOT (ci_lower <= ml_score AND ml_score <= ci_upper) OR confidence NOT BETWEEN 0 AND 1").count() == 0
    rows = panel.join(pred.select("trade_date", "ts_code", "ml_score", "confidence"), ["trade_date", "ts_code"]).withColumn("score", F.col("ml_score"))
    rows = rows.withColumn("benchmark_weight", F.col("amount"))  # the fixture's member weights can be negative
    prepared = stage(prepare_snapshot(snapshots(rows).select("rebalance_date", "ts_code", "industry_name", "benchmark_weight", "score", "confidence")))
    kept = candidate_filter(prepared, 0.7, 5)
    sizes = prepared.groupBy("rebalance_date").count().join(kept.groupBy("rebalance_date").agg(F.count("*").alias("k")), "rebalance_date")
    assert sizes.where("k <> greatest(ceil(count * 0.7D), least(5, count))").count() == 0
    book = backtest.tilted_positions(prepared, panel, risk.Limits(max_weight=0.15))
    sums = book.groupBy("rebalance_date").agg(F.sum("weight").alias("w")).collect()
    assert sums and all(abs(x["w"] - 1) < 1e-4 for x in sums)
    metrics = backtest.from_positions(panel, book).metrics.first()
    assert metrics["avg_ex_ante_tracking_error"] > 0


def test_point_in_time_weights_sum_to_one(feeds):
    f, d = feeds
    members = d.membership().select("month", F.col("ts_code")).select("month", raw_to_code().alias("ts_code"))
    pit = panels.point_in_time_panel(f, members)
    sums = pit.groupBy("trade_date").agg(F.sum("benchmark_weight").alias("w")).where("abs(w - 1) > 1e-9")
    assert sums.count() == 0 and pit.count() < d.bars().count()


def raw_to_code():
    from alphaloom.functions.columns import security_code

    return security_code(raw_code())


def test_ablation_labels_every_variant(panel):
    run = studies.feature_ablation(panel, {"technical": ["ret_20", "volatility_20"], "quality": ["roe"]}, 10)
    got = {r["variant"]: r["feature_count"] for r in run.metrics.collect()}
    assert got == {"technical": 2, "quality": 1}
