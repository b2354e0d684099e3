"""Hand-made inputs for the rules that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from alphaloom import schemas
from alphaloom.functions import columns as C
from alphaloom.operators.conformal import conformal_rank, trust_gate
from alphaloom.operators.cross_section import group_median, winsorize_mad, zscore
from alphaloom.operators.factors import compute_factors, full_window, by_security, resolve_features
from alphaloom.plans.studies import variant_features
from alphaloom.operators.joins import asof_join
from alphaloom.operators.nav import daily_nav
from alphaloom.operators.positions import top_n, with_turnover
from alphaloom.sources import readers, sinks
from alphaloom.sources.quality import bundle_summary, quality_gate


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def cross(spark, values):
    return spark.createDataFrame([(f"s{i}", day(0), v) for i, v in enumerate(values)], "ts_code string, trade_date date, x double")


def column(df, c="x", by="ts_code"):
    return [r[c] for r in df.orderBy(by).collect()]


def test_mad_leaves_a_group_with_a_null_alone(spark):
    df = cross(spark, [1.0, 2.0, None, 100.0])
    assert column(winsorize_mad(df, ["x"])) == [1.0, 2.0, None, 100.0]
    assert column(winsorize_mad(df, ["x"], strict_nulls=False))[3] < 100.0


def test_mad_clips(spark):
    assert column(winsorize_mad(cross(spark, [1.0, 2.0, 3.0, 100.0]), ["x"])) == [1.0, 2.0, 3.0, 5.5]


def test_mad_is_the_same_with_brackets(spark, monkeypatch):
    import alphaloom.operators.order_stats as os_

    df = cross(spark, [float((i * 37) % 101) ** 2 for i in range(400)])
    plain = column(winsorize_mad(df, ["x"]))
    monkeypatch.setattr(os_, "BRACKET_FROM", 10)
    assert column(winsorize_mad(df, ["x"])) == plain


@pytest.mark.parametrize("values", [[1.0, 1.0], [5.0]])
def test_no_spread_gives_null_z(spark, values):
    assert column(zscore(cross(spark, values), ["x"])) == [None] * len(values)


def test_null_industry_gives_null_z(spark):
    df = cross(spark, [1.0, 2.0, 3.0]).withColumn("industry_name", F.when(F.col("ts_code") != "s2", "a"))
    z = column(zscore(df, ["x"], ["trade_date", "industry_name"]))
    assert z[2] is None and z[0] == pytest.approx(-math.sqrt(0.5))


def test_nan_is_missing(spark):
    df = cross(spark, [1.0, float("nan"), 3.0]).withColumn("x", C.null_if_nan(F.col("x")))
    assert column(group_median(df, ["trade_date"], {"m": F.col("x")}), "m") == [2.0] * 3


def series(spark, values):
    return spark.createDataFrame([("a", day(i), v) for i, v in enumerate(values)], "ts_code string, trade_date date, close double")


def test_rolling_needs_a_full_window(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0])
    got = df.withColumn("m", full_window(F.avg("close"), F.col("close"), by_security(), 3))
    assert column(got, "m", "trade_date") == [None] * 5


def test_pct_change_carries_over_gaps(spark):
    got = column(compute_factors(series(spark, [1.0, 2.0, None, 4.0, 5.0])), "daily_return", "trade_date")
    assert got == [None, 1.0, 0.0, 1.0, 0.25]


def test_asof_takes_latest_period_and_whole_rows(spark):
    left = spark.createDataFrame([("a", day(3)), ("b", day(3)), ("c", day(3))], "ts_code string, trade_date date")
    right = spark.createDataFrame(
        [("a", day(1), day(-90), 1.0), ("a", day(1), day(-1), 2.0), ("b", day(1), day(-1), 2.0), ("b", day(2), day(0), None), ("c", day(4), day(0), 9.0)],
        "ts_code string, ann_date date, end_date date, roe double",
    )
    assert column(asof_join(left, right), "roe") == [2.0, None, None]


@pytest.mark.parametrize("n, rank", [(10, 10), (20, 20), (100, 92)])
def test_finite_sample_rank(spark, n, rank):
    got = spark.range(1).select(conformal_rank(0.1)(F.lit(n)).alias("r")).first()["r"]
    assert got == rank


def test_score_ties_go_to_the_smaller_code(spark):
    df = spark.createDataFrame([(day(0), c, 1.0) for c in "cab"], "rebalance_date date, ts_code string, score double")
    assert column(top_n(df, 2), "ts_code") == ["a", "b"]


def test_first_rebalance_pays_and_weights_start_next_day(spark):
    panel = spark.createDataFrame(
        [(c, day(i), 0.1, 0.0) for c in "ab" for i in range(3)], "ts_code string, trade_date date, daily_return double, benchmark_daily_return double"
    )
    book = with_turnover(top_n(spark.createDataFrame([(day(0), c, 1.0) for c in "ab"], "rebalance_date date, ts_code string, score double"), 2))
    nav = daily_nav(panel, book).orderBy("trade_date").collect()
    assert book.first()["turnover"] == 0.5
    assert nav[0]["gross_portfolio_return"] == 0.0 and nav[0]["transaction_cost"] == pytest.approx(0.002)
    assert nav[1]["portfolio_nav"] == pytest.approx(0.998 * 1.1)


@pytest.mark.parametrize("raw, padded, code", [("1", "000001", "1"), ("sz.000001", "000001", "000001.SZ"), ("1234567", "1234567", "1234567"), ("600000", "600000", "600000.SH"), ("688001.SH", "688001.SH", "688001.SH"), ("300750", "300750", "300750.SZ")])
def test_codes(spark, raw, padded, code):
    row = spark.createDataFrame([(raw,)], "c string").select(C.zero_pad_code(F.col("c")).alias("p"), C.security_code(F.col("c")).alias("s")).first()
    assert (row["p"], row["s"]) == (padded, code)


@pytest.mark.parametrize("hits, n, trust", [(50, 100, 0.0), (70, 100, 0.5), (95, 100, 1.0), (40, 40, 0.5)])
def test_trust_gate(spark, hits, n, trust):
    cal = spark.createDataFrame([(day(i), i + 1) for i in range(30)], "trade_date date, idx int")
    rows = [(day(0), f"s{i}", 0.0, -1.0 if i < hits else 1.0, 2.0) for i in range(n)]
    pred = spark.createDataFrame(rows, "trade_date date, ts_code string, label_excess_return_20d double, ci_lower double, ci_upper double")
    got = trust_gate(pred, cal, spark.createDataFrame([(day(19),), (day(20),)], "trade_date date")).orderBy("rebalance_date").collect()
    assert got[0]["trust"] == 0.5 and got[1]["trust"] == pytest.approx(trust)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="ci_lower"):
        schemas.require_columns(cross(spark, [1.0]), ["ci_lower"])


def test_feature_registry():
    assert resolve_features(available=["roe", "ret_20"]) == ["roe", "ret_20"]
    with pytest.raises(ValueError):
        resolve_features(["nope"])
    assert resolve_features(["value", "value"], ["x"], ["x", "bp"]) == ["bp", "x"]
    assert variant_features(["bp", "ret_20"]) == {"fundamental_only": ["bp"], "technical_only": ["ret_20"], "full_factor": ["bp", "ret_20"]}
    assert list(variant_features(["m2_yoy", "northbound_net_inflow", "cn_spread_10y_2y"]))[-1] == "full_with_external"
    assert variant_features(["bp"], {"mine": ["value"]}) == {"mine": ["bp"]}


def test_bundle_names_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="daily_valuation.csv"):
        readers.load_bundle(spark, str(tmp_path))


def test_csv_keeps_leading_zeros_and_drops_the_bom(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("﻿code,weight\n000001,0.5\n".encode())
    assert readers.read_csv(spark, str(p)).first().asDict() == {"code": "000001", "weight": "0.5"}


def test_quality_gate(spark):
    empty = spark.createDataFrame([("a", None)] * 30, "ts_code string, roe double")
    with pytest.raises(ValueError, match="roe"):
        quality_gate(bundle_summary({"financials": (empty, ["roe"])}))


def test_append_and_partitioned_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    for v in ("a", "b"):
        sinks.append_variant(cross(spark, [1.0]), path, v)
    assert {r["variant"] for r in spark.read.parquet(path).collect()} == {"a", "b"}


def test_empty_table_is_typed(spark):
    t = schemas.empty_table(spark, "nav")
    assert t.count() == 0 and dict(t.dtypes)["portfolio_nav"] == "double"
