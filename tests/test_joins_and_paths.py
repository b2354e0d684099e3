"""Inputs on which joins, profiles and paths used to lose or mix rows."""

import datetime as dt

import pytest

from alphaloom.operators.joins import asof_join, asof_series, join_date_series
from alphaloom.operators.membership import benchmark_profile
from alphaloom.operators.risk import Limits, aligned_windows
from alphaloom.operators.tilt import capped_base, turnover_path
from alphaloom.sources import readers


def day(n):
    return dt.date(2020, 1, n)


def test_asof_takes_a_latest_row_without_tie_value(spark):
    right = spark.createDataFrame([("a", day(1), day(1), 1.0), ("a", day(3), None, 2.0)], "ts_code string, ann_date date, end_date date, roe double")
    left = spark.createDataFrame([("a", day(2)), ("a", day(5))], "ts_code string, trade_date date")
    got = {r.trade_date: r.roe for r in asof_join(left, right).collect()}
    assert got == {day(2): 1.0, day(5): 2.0}


def test_asof_prefers_a_row_with_tie_value_and_decides_equal_ones(spark):
    rows = [("a", day(1), None, 9.0), ("a", day(1), day(1), 1.0), ("a", day(1), day(1), 3.0)]
    right = spark.createDataFrame(rows, "ts_code string, ann_date date, end_date date, roe double")
    left = spark.createDataFrame([("a", day(2))], "ts_code string, trade_date date")
    assert asof_join(left, right).first().roe == 3.0


def test_date_series_join_keeps_whole_rows(spark):
    series = spark.createDataFrame([(day(1), 1.0, 9.0), (day(1), 2.0, 3.0)], "trade_date date, x double, y double")
    panel = spark.createDataFrame([(day(1),)], "trade_date date")
    assert tuple(join_date_series(panel, series).first())[1:] == (1.0, 9.0)
    assert tuple(asof_series(panel, series).first())[1:] == (2.0, 3.0)


@pytest.mark.parametrize(("as_of", "want"), [(None, {"a": 0.2, "b": 0.8}), ("2020-01-02", {"a": 0.9, "b": 0.1}), ("2019-01-01", {})])
def test_profile_is_of_one_date(spark, as_of, want):
    u = spark.createDataFrame([("a", day(1), 0.2), ("b", day(1), 0.8), ("a", day(2), 0.9), ("b", day(2), 0.1)], "con_code string, trade_date date, weight double")
    codes = spark.createDataFrame([("a",), ("b",)], "ts_code string")
    assert {r.ts_code: pytest.approx(r.benchmark_weight) for r in benchmark_profile(u, codes, as_of).collect()} == want


def test_path_keeps_scenarios_apart(spark):
    """Values with the separator in them, and NULLs, are scenarios of their own."""
    rows = []
    for s, t, code in (("x|y", "z", "c1"), ("x", "y|z", "c2"), (None, "x", "c3"), ("x", None, "c4")):
        rows += [(s, t, d, c, float(c == code)) for d in (day(1), day(2)) for c in ("c1", "c2", "c3", "c4")]
    targets = spark.createDataFrame(rows, "s string, t string, rebalance_date date, ts_code string, weight double")
    got = {(r.s, r.t, r.rebalance_date): (r.ts_code, r.weight) for r in turnover_path(targets, Limits(), ["s", "t"], {("x", None): 0.1}).collect()}
    assert len(got) == 8 and all(w == pytest.approx(1.0) for _, w in got.values())
    assert got["x|y", "z", day(2)][0] == "c1" and got["x", "y|z", day(2)][0] == "c2" and got["x", None, day(1)][0] == "c4"


def test_aligned_windows_fill_missing_returns(spark):
    windows = spark.createDataFrame([(day(9), "a", day(1), 0.5), (day(9), "a", day(2), 0.25), (day(9), "b", day(2), 1.0)], "rebalance_date date, ts_code string, trade_date date, x double")
    snapshot = spark.createDataFrame([(day(9), "a"), (day(9), "b"), (day(9), "c")], "rebalance_date date, ts_code string")
    got = {(r.ts_code, r.trade_date): r.x for r in aligned_windows(windows, snapshot).collect()}
    assert got == {("a", day(1)): 0.5, ("a", day(2)): 0.25, ("b", day(1)): 0.0, ("b", day(2)): 1.0, ("c", day(1)): 0.0, ("c", day(2)): 0.0}


def test_empty_slice_keeps_its_columns(spark):
    bars = spark.createDataFrame([("a", day(3), 1.0)], "ts_code string, trade_date date, close double")
    none = readers.slice_rows(bars, None, "1900-01-01", "1900-12-31")
    assert none.columns == bars.columns and none.count() == 0 and readers.concat_tables([bars, none]).count() == 1


@pytest.mark.parametrize("cap", [0.5, 0.3, 0.25])
def test_base_book_is_capped_and_spread_inside_the_industry_first(spark, cap):
    weights = {"a": ("x", 0.6), "b": ("x", 0.1), "c": ("y", 0.2), "d": ("y", 0.1), "e": ("y", 0.0)}
    df = spark.createDataFrame([(day(1), k, i, w, cap) for k, (i, w) in weights.items()], "rebalance_date date, ts_code string, industry_name string, benchmark_weight double, max_weight double")
    got = {r.ts_code: r["_base"] for r in capped_base(df, ["rebalance_date"]).collect()}
    assert max(got.values()) <= cap + 1e-12 and got["e"] == 0 and sum(got.values()) == pytest.approx(1.0)
    if cap == 0.5:  # industry x has room for its own excess
        assert got["a"] + got["b"] == pytest.approx(0.7) and got["c"] == pytest.approx(0.2)


def test_base_book_is_the_benchmark_where_that_is_within_the_cap(spark):
    df = spark.createDataFrame([(day(1), k, "x", w, 0.5) for k, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))], "rebalance_date date, ts_code string, industry_name string, benchmark_weight double, max_weight double")
    assert {r.ts_code: pytest.approx(r["_base"]) for r in capped_base(df, ["rebalance_date"]).collect()} == {"a": 0.5, "b": 0.3, "c": 0.2}
