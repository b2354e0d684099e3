"""What a query moves follows the rows it needs: order statistics, return windows, as-of joins, configurations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import order_stats, risk
from alphaloom.operators.joins import asof_join


@pytest.mark.parametrize("bins", [2, 64])
def test_brackets_of_many_small_groups_keep_few_rows(spark, bins, monkeypatch):
    monkeypatch.setattr(order_stats, "BRACKET_FROM", 10)
    monkeypatch.setattr(order_stats, "BINS", bins)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.repeat(np.arange(20), 200), "n": rng.standard_normal(4000), "c": np.round(rng.standard_cauchy(4000), 1)})
    pdf.loc[pdf["k"] == 3, "n"] = 2.5
    pdf.loc[rng.random(4000) < 0.1, "c"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    stats = {"m": order_stats.median(F.col("n")), "q": order_stats.quantile(F.col("c"), 0.3)}
    got = order_stats.grouped_order_stats(df, ["k"], stats).toPandas().set_index("k").sort_index()
    assert np.allclose(got["m"], pdf.groupby("k")["n"].median()) and np.allclose(got["q"], pdf.groupby("k")["c"].quantile(0.3))
    rows = df.select("k", F.col("n").alias("__v0"), F.col("c").alias("__v1"))
    ends = order_stats._ends(rows, 2)
    table = order_stats._brackets(rows, ["k"], list(stats.values()), ends)
    inside = rows.join(table, "k").where(order_stats._bin(F.col("__v0"), ends[0]).between(F.col("__first0"), F.col("__last0")) & (F.col("k") != 3))
    assert inside.count() < 3800 * (0.15 if bins == 64 else 0.9)  # groups of 200 rows were counted whole before


def test_return_windows_shuffle_one_row_a_snapshot_row(spark):
    days = pd.date_range("2020-01-01", periods=30).date
    rows = [(c, d, None if i == 0 or (c == 2 and i % 3) else float(c * 100 + i)) for c in (1, 2, 3) for i, d in enumerate(days)]
    panel = spark.createDataFrame(rows, "ts_code long, trade_date date, daily_return double")
    snapshot = spark.createDataFrame([(days[20], 1), (days[20], 2), (days[29], 2), (days[29], 9)], "rebalance_date date, ts_code long")
    got = risk.return_windows(snapshot, panel, 5)
    found = {(r.rebalance_date, r.ts_code, r.trade_date): (r.x, r.t, r.n_days) for r in got.collect()}
    want = {(days[20], 1, days[i]): (100.0 + i, 20 - i, 5) for i in range(15, 20)}
    want |= {(days[20], 2, days[i]): (200.0 + i, 20 - i, 5) for i in (15, 18)}
    want |= {(days[29], 2, days[i]): (200.0 + i, t, 5) for t, i in enumerate((27, 24, 21, 18, 15), 1)}
    assert found == want
    plan = risk._histories(snapshot, panel, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Window" not in plan


def test_as_of_join_moves_windowed_rows_once(spark):
    from pyspark.sql import Window as W

    left = spark.range(40).select((F.col("id") % 4).alias("ts_code"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    left = left.withColumn("n", F.row_number().over(W.partitionBy("ts_code").orderBy("trade_date")))
    right = spark.range(4).select(F.col("id").alias("ts_code"), F.lit("2020-01-10").cast("date").alias("ann_date"), F.lit("2019-12-31").cast("date").alias("end_date"), F.lit(1.0).alias("roe"))
    out = asof_join(left, right)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Union")[0]
    assert sum(r.roe is not None for r in out.collect()) == 31


def test_configuration_panel_needs_no_join_of_two_panels(spark, monkeypatch):
    from alphaloom.plans import studies
    from checks import q_configs
    from checks.fixtures import FEATURES

    rows = [(c, d, 1.0, f"i{c % 2}", *[float(c + i) for i in range(len(FEATURES))]) for c in (1, 2) for d in pd.date_range("2020-01-01", periods=2).date]
    rows.append((None, rows[0][1], 1.0, None, *[9.0] * len(FEATURES)))
    panel = spark.createDataFrame(rows, "ts_code long, trade_date date, amount double, industry_name string, " + ", ".join(f"{c} double" for c in FEATURES))

    class Views:
        def external(self):
            return panel

        def labeled(self):
            return panel

    seen = []
    monkeypatch.setattr(studies, "configurations", lambda p, *a: seen.append(p))
    monkeypatch.setattr(studies, "configuration_table", lambda p, *a: spark.createDataFrame([(0.0,) * 6], ", ".join(f"{c} double" for c in q_configs.SHOWN)))
    q_configs.exp06(Views())
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.ts_code, r.score) for r in seen[0].collect()} == {(c, round(c + (0 - 1 + 2 + 3 + 4 - 2 * c) / 5, 8)) for c in (1, 2)}


def test_dates_without_separators_are_parsed_once(spark):
    from alphaloom.functions.columns import to_date

    texts = ["2020-01-31", "20200131", "2020-1-3", "2020/01/31", "2020-13-01", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(to_date(F.col("t")).alias("d"))
    assert [r.d and str(r.d) for r in df.collect()] == ["2020-01-31", "2020-01-31"] + [None] * 6
    assert "Contains(t" in df._jdf.queryExecution().optimizedPlan().toString() or "contains(t" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_conformal_runs_stage_only_what_quantiles_need(spark, monkeypatch):
    from alphaloom.operators import conformal

    days = pd.bdate_range("2019-01-01", "2020-12-31").date
    rows = [(c, d, float((c * 7 + i) % 11), float((c * 5 + i) % 13) / 10) for c in range(3) for i, d in enumerate(days)]
    panel = spark.createDataFrame(rows, "ts_code long, trade_date date, x double, label_excess_return_20d double")
    kept, plain = [], conformal.calibrate

    def calibrate(*a, **k):
        kept.append(plain(*a, **k))
        return kept[-1]

    monkeypatch.setattr(conformal, "calibrate", calibrate)
    conformal.conformal_predictions(panel, ["x"], train_months=6, min_train_rows=10)
    assert kept[0].scores.columns == ["window_id", "score"]


def test_codes_need_no_regex_a_branch(spark):
    from alphaloom.functions.columns import security_code, zero_pad_code

    texts = ["sh.600000", "sz.1", "600000", "1", "600000.SH", "sh.sz.7", "SH.600000", "", None, "sh", "1234567", "688001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(security_code(zero_pad_code(F.col("t"))).alias("c"))
    want = ["600000.SH", "000001.SZ", "600000.SH", "000001.SZ", "600000.SH", "00sz.7", "SH.600000", "000000.SZ", None, "0000sh.SZ", "1234567", "688001.SH"]
    assert [r.c for r in df.collect()] == want
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp") + df._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") <= 1


def test_order_statistics_of_many_columns_are_code_that_the_jvm_compiles(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(order_stats, "stage", lambda df: seen.append(df) or df)
    rows = spark.range(100).select((F.col("id") % 4).alias("k"), *[(F.col("id") * i % 17).cast("double").alias(f"v{i}") for i in range(1, 9)])
    monkeypatch.setattr(order_stats, "BRACKET_FROM", 10)
    out = order_stats.grouped_order_stats(rows, ["k"], {f"m{i}": order_stats.median(F.col(f"v{i}")) for i in range(1, 9)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the range of a value was written out once a statistic in each place that needs it
    assert plan.count("FLOOR(") + plan.count("floor(") < 40
    want = rows.toPandas().groupby("k").median()
    got = out.toPandas().set_index("k").sort_index()
    assert all(np.allclose(got[f"m{i}"], want[f"v{i}"]) for i in range(1, 9))


def test_a_path_of_several_tasks_takes_no_second_a_date(spark):
    import time

    from alphaloom.operators.tilt import turnover_path

    days = pd.date_range("2021-01-01", periods=60).date
    rows = [(d, c, 1.0 / 12) for k, d in enumerate(days) for c in range(k % 3, 12 + k % 3)]
    targets = spark.createDataFrame(rows, "rebalance_date date, ts_code long, weight double")
    turnover_path(targets.where(F.col("rebalance_date") <= days[1]), rows_per_task=5).count()
    began = time.monotonic()
    path = turnover_path(targets, rows_per_task=5).toPandas()
    assert time.monotonic() - began < 30  # 60 rounds of allGather take 60 s
    sums = path.groupby("rebalance_date").weight.sum()
    assert len(sums) == 60 and np.allclose(sums, 1.0)


def test_tasks_that_share_no_folder_still_meet(spark):
    from pyspark import BarrierTaskContext

    from alphaloom.operators.tilt import _exchange

    def run(batches):
        context = BarrierTaskContext.get()
        swap = _exchange(context, f"/proc/none/{context.partitionId()}")
        texts = [",".join(swap(i, f"{context.partitionId()}.{i}")) for i in range(2)]
        for b in batches:
            yield pd.DataFrame({"t": [";".join(texts)] * min(1, len(b))})

    got = spark.range(0, 30, 1, 3).mapInPandas(run, "t string", barrier=True).collect()
    assert {r.t for r in got} == {"0.0,1.0,2.0;0.1,1.1,2.1"}


def test_seeds_share_their_windows_and_run_at_the_same_time(spark, monkeypatch):
    import threading

    from alphaloom.plans import studies

    plans, meeting = [], threading.Barrier(2, timeout=60)

    def recorded(panel, features, split_key=None, plan=None, **more):
        plans.append((split_key, plan))
        meeting.wait()
        rows = panel.select("trade_date", "ts_code", (F.col("ts_code") * split_key).alias("ml_score"))
        return type("R", (), {"predictions": rows})

    monkeypatch.setattr(studies, "conformal_predictions", recorded)
    monkeypatch.setattr(studies, "rolling_plan", lambda *a, **k: "windows")
    days = pd.date_range("2021-01-01", periods=70).date
    panel = spark.createDataFrame([(d, c, c / 1e3, 0.001) for d in days for c in (1, 2, 3)], "trade_date date, ts_code long, daily_return double, benchmark_daily_return double")
    run = studies.seed_runs(panel, ["x"], lambda s: s, seeds=(1, -1), n=2)
    assert sorted(plans) == [(-1, "windows"), (1, "windows")]
    held = {(r.seed, r.ts_code) for r in run.positions.select("seed", "ts_code").distinct().collect()}
    assert held == {(1, 3), (1, 2), (-1, 1), (-1, 2)}


def test_rows_below_a_bracket_are_not_counted_again(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BRACKET_FROM", 10)
    rows = spark.range(2000).select((F.col("id") % 2).alias("k"), F.pow(F.col("id").cast("double"), 2.0).alias("v"))
    staged = []
    monkeypatch.setattr(order_stats, "stage", lambda df: staged.append(df) or df)
    out = order_stats.grouped_order_stats(rows, ["k"], {"q": order_stats.quantile(F.col("v"), 0.9)})
    got = {r.k: (r.q, r.q_n, r.q_less, r.q_ties) for r in out.collect()}
    v = rows.toPandas().groupby("k").v
    for k, q in v.quantile(0.9).items():
        x = np.sort(v.get_group(k))
        assert np.isclose(got[k][0], q) and got[k][1:] == (1000, int((x < x[899]).sum()), 1)
    below = {r.k: r["__below0"] for r in staged[0].collect()}
    assert all(800 < below[k] <= 899 for k in below)  # so many rows a group were shuffled as one more part


def test_gram_of_returns_by_code_refuses_a_code_twice_a_day():
    import pyarrow as pa

    rows = {"rebalance_date": [1, 1], "_salt": [0, 0], "n_days": [3, 3], "t": [[2, 1], [3]], "r": [[1.0, None], [6.0]]}
    table = pa.table({k: pa.array(x) for k, x in rows.items()})
    x = np.array([[0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 6.0, 0.0]])
    x[:, :3] -= x[:, :3].mean(axis=1, keepdims=True)
    assert np.allclose(risk._gram(4)(table)["g"][0].as_py(), (x.T @ x)[np.triu_indices(4)])
    with pytest.raises(ValueError, match="several returns"):
        risk._gram(4)(table.set_column(3, "t", pa.array([[2, 2], [3]])))


def test_external_panel_stages_its_series_alone(spark, small):
    from checks import fixtures

    d = fixtures.Data(spark, small)
    rows = d.external()
    assert not hasattr(rows, "staged_path") and d.series().count() == d.model().select("trade_date").distinct().count()
    assert rows.columns[-2:] == ["northbound_net_inflow", "cn_spread_10y_2y"] and rows.count() == d.model().count()
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_a_staged_table_leaves_no_shuffle_files(spark):
    from alphaloom.operators import staging

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key, "false"), []

    def rows(batches):
        yield from batches

    with staging.shuffles_dropped(spark):
        with staging.shuffles_dropped(spark):
            pass
        seen.append(spark.conf.get(key))
    table = staging.stage(spark.range(1000).repartition(4).mapInPandas(rows, "id long"))
    assert seen == ["true"] and spark.conf.get(key, "false") == before
    assert table.count() == 1000 and any(".zstd." in f for f in table.inputFiles())
