"""Learners under the conformal intervals, moments that merge, and the turnover path, against plain numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import tilt
from alphaloom.operators.conformal import calibrate, calibration_split, conformal_predictions, conformal_rank
from alphaloom.operators.learners import EPS, Boosted, Forest, LeastSquares, LinearModel, Target, assembled
from alphaloom.operators.moments import least_squares, merged, moments, pairs, solved
from alphaloom.operators.risk import Limits, active_variance
from alphaloom.operators.split import split_windows
from alphaloom.operators.training import LABEL, TrainingPlan, boosted_alpha, ols_variants, rolling_plan, training_rows
from checks import fixtures

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panel(spark):
    """Three features, one of them constant on many days, a label with a known shape, missing values."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(150):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=2 * k)
        for code in range(30):
            a, b, c = rng.normal(), rng.normal(), float(k % 3)
            y = 0.5 * a - 0.2 * b + 0.1 * c + rng.normal() * (0.1 + 0.2 * abs(b))
            rows.append((day, code, float(a) if code % 11 else None, float(b), c, None if code % 13 == 0 else float(y), f"i{code % 3}"))
    return spark.createDataFrame(rows, f"trade_date date, ts_code long, a double, b double, c double, {LABEL} double, industry_name string").cache()


@pytest.fixture(scope="module")
def plan(panel):
    return rolling_plan(panel, 4, 10)


def key():
    return (F.col("ts_code") * 7919 + F.unix_date("trade_date") * 104729) % 100_003


def windows_of(panel, plan):
    """Rows of every window with their part, from the copying split."""
    rows = calibration_split(training_rows(panel, plan), key()).toPandas()
    return {w: g.fillna({f: 0.0 for f in FEATURES}) for w, g in rows.groupby("window_id")}


def design(g):
    return np.column_stack([np.ones(len(g)), g[FEATURES].to_numpy()])


def test_split_is_that_of_the_copied_rows(panel, plan):
    split, want = split_windows(panel, plan.windows, LABEL, key(), 0.3, 4), windows_of(panel, plan)
    for part, flag in ((split.proper(), False), (split.calibration(), True)):
        got = part.select("window_id", "trade_date", "ts_code").toPandas()
        assert sorted(map(tuple, got.to_numpy())) == sorted((w, r.trade_date, r.ts_code) for w, g in want.items() for r in g[g.is_calibration == flag].itertuples())


def test_least_squares_and_residual_spread_match_numpy(panel, plan):
    fitted = calibrate(panel, plan, FEATURES, LABEL, key(), 0.3, 4, True)
    base, spread = ({r.window_id: np.array(r.coef) for r in m.table.collect()} for m in (fitted.base, fitted.sigma))
    want = windows_of(panel, plan)
    assert set(base) == set(spread) == set(want) and len(want) >= 4
    for w, g in want.items():
        train = g[~g.is_calibration]
        b = np.linalg.lstsq(design(train), train[LABEL], rcond=None)[0]
        s = np.linalg.lstsq(design(train), np.log(abs(train[LABEL] - design(train) @ b) + EPS), rcond=None)[0]
        assert np.allclose(base[w], b, atol=1e-9) and np.allclose(spread[w], s, atol=1e-8)


def test_other_base_and_linear_spread(panel, plan):
    """A spread fitted on any base's residuals is the regression on those residuals."""
    split = split_windows(panel, plan.windows, LABEL, key(), 0.3, 4)
    forest = Forest(trees=5, depth=2).fit(split, FEATURES, Target(LABEL))
    spread = LeastSquares().fit(split, FEATURES, Target(LABEL, forest))
    got = {r.window_id: np.array(r.coef) for r in spread.table.collect()}
    rows = forest.predict(split.proper(), "fit").toPandas().fillna({f: 0.0 for f in FEATURES})
    for w, g in rows.groupby("window_id"):
        want = np.linalg.lstsq(design(g), np.log(abs(g[LABEL] - g["fit"]) + EPS), rcond=None)[0]
        assert np.allclose(got[w], want, atol=1e-7)


@pytest.mark.parametrize("learner", [Forest(trees=8, depth=3, at_once=2), Boosted(rounds=3, depth=2, at_once=2)])
def test_trees_under_the_intervals(panel, plan, learner):
    """Scores are those of a model fitted by hand on the window's proper rows; quantiles those of its calibration scores."""
    some = [r.window_id for r in plan.bounds.orderBy("window_id").collect()][:2]
    small = TrainingPlan(*[t.where(F.col("window_id").isin(some)) for t in (plan.windows, plan.targets, plan.bounds)])
    result = conformal_predictions(panel, FEATURES, plan=small, min_train_rows=4, split_key=key(), base=learner, sigma=learner.shallower())
    got = result.predictions.toPandas()
    assert set(got.trade_date) == set(some) and (got.ci_half_width > 0).all()
    split = split_windows(panel, small.windows, LABEL, key(), 0.3, 4)
    fitted = calibrate(panel, small, FEATURES, LABEL, key(), 0.3, 4, True, learner, learner.shallower())
    for w in some:
        base, spread = fitted.base.models[w], fitted.sigma.models[w]
        own = learner.estimator().setFeaturesCol("_x").setLabelCol("_target").fit(assembled(Target(LABEL).of(split.proper(w)), FEATURES))
        assert own.featureImportances.toArray() == pytest.approx(base.featureImportances.toArray(), abs=0.35)

        def both(rows):
            rows = base.setPredictionCol("p").transform(assembled(rows, FEATURES))
            return spread.setPredictionCol("s").transform(rows).select("ts_code", LABEL, "p", "s").toPandas()

        calib = both(split.calibration().where(F.col("window_id") == F.lit(w)))
        scores = np.sort(abs(calib[LABEL] - calib.p) / (np.exp(calib.s) + EPS))
        n = len(scores)
        q = scores[min(min(int(np.ceil((n + 1) * 0.9)), n) + 1, n) - 1]
        here = both(panel.where(F.col("trade_date") == F.lit(w))).set_index("ts_code")
        mine = got[got.trade_date == w].set_index("ts_code")
        assert np.allclose(mine.ml_score, here.p.loc[mine.index]) and np.allclose(mine.ci_half_width, q * (np.exp(here.s.loc[mine.index]) + EPS))
    assert set(result.importance.toPandas().feature) == set(FEATURES)


def test_boosted_learns_a_signal_and_goes_on_where_it_stopped(panel, plan, tmp_path):
    some = [r.window_id for r in plan.bounds.orderBy("window_id").collect()][:2]
    small = TrainingPlan(*[t.where(F.col("window_id").isin(some)) for t in (plan.windows, plan.targets, plan.bounds)])
    store, params = f"file://{tmp_path}/run", Boosted(rounds=15, step=0.2, depth=3, at_once=2)
    first = boosted_alpha(panel, small, FEATURES, min_train_rows=30, params=params, store=store).predictions.toPandas()
    assert first[["ml_score", LABEL]].dropna().corr().iloc[0, 1] > 0.6
    marks = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("_SUCCESS")}
    again = boosted_alpha(panel, plan, FEATURES, min_train_rows=30, params=Boosted(rounds=1, at_once=2), store=store).predictions.toPandas()
    assert all(p.stat().st_mtime_ns == t for p, t in marks.items()) and len(marks) == 4
    both = again.merge(first, on=["trade_date", "ts_code"], suffixes=("", "_first"))
    assert len(both) == len(first) < len(again) and np.allclose(both.ml_score, both.ml_score_first)


def test_variants_share_one_table_of_moments(panel, plan):
    variants = {"one": ["b"], "two": ["c", "a"], "all": FEATURES}
    got = ols_variants(panel, plan, variants, min_train_rows=30)
    scores = got.predictions.toPandas()
    train = training_rows(panel, plan).toPandas().fillna({f: 0.0 for f in FEATURES})
    whole = panel.toPandas().fillna({f: 0.0 for f in FEATURES}).set_index(["trade_date", "ts_code"])
    for (name, w), g in scores.groupby(["variant", "trade_date"]):
        t = train[train.window_id == w]
        x = lambda d: np.column_stack([np.ones(len(d)), d[variants[name]].to_numpy()])  # noqa: E731,B023
        b = np.linalg.lstsq(x(t), t[LABEL], rcond=None)[0]
        here = whole.loc[[(r.trade_date, r.ts_code) for r in g.itertuples()]]
        assert np.allclose(g.ml_score, x(here) @ b, atol=1e-9)
    assert got.importance.groupBy("variant").agg(F.countDistinct("feature").alias("n")).orderBy("variant").toPandas().n.tolist() == [3, 1, 2]


def test_moments_keep_the_digits_of_a_large_mean(spark):
    """Mean 1e6, spread 1: slopes to 1e-9, also after merging parts."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=4000)
    want = np.linalg.lstsq(np.column_stack([np.ones(4000), x]), y, rcond=None)[0]
    df = spark.createDataFrame([(i % 40, float(p + 1e6), float(q + 1e6), float(t + 1e6)) for i, ((p, q), t) in enumerate(zip(x, y))], "g int, a double, b double, y double")
    cols = [F.col("a"), F.col("b")]
    direct = least_squares(df.withColumn("k", F.lit(1)), cols, F.col("y"), ["k"]).first()["coef"]
    parts = moments(df, ["g"], cols, F.col("y")).withColumn("k", F.lit(1))
    joined = solved(merged(parts, ["k"], 2), 2, ["k"]).first()["coef"]
    for coef in (direct, joined):
        assert abs(coef[1] - want[1]) < 1e-9 and abs(coef[2] - want[2]) < 1e-9
    assert pairs(1) == [(0, 0), (0, 1), (1, 1)]


def test_moments_without_spread_give_no_slope(spark):
    df = spark.createDataFrame([(1, 2.0, float(i), 3.0 * i) for i in range(10)], "k int, a double, b double, y double")
    coef = least_squares(df, [F.col("a"), F.col("b")], F.col("y"), ["k"]).first()["coef"]
    assert np.allclose(coef, [0.0, 0.0, 3.0])
    assert LinearModel(("a",), df).importance is not None


def test_variance_of_sums_with_a_large_mean(spark):
    """Returns near one level: the centred variance, where raw moments would cancel."""
    rng = np.random.default_rng(4)
    x = 1e5 + rng.normal(size=60) * 1e-3
    windows = spark.createDataFrame([("d", 1, t + 1, float(v)) for t, v in enumerate(x)], "rebalance_date string, ts_code int, t int, x double")
    shrink = spark.createDataFrame([("d", 60, 0.0, 0.0)], "rebalance_date string, n_days int, mu double, shrink double")
    active = spark.createDataFrame([("d", 1, 1.0)], "rebalance_date string, ts_code int, a double")
    got = active_variance(active, windows, shrink, ridge=0.0).first()["active_variance"]
    assert got == pytest.approx(np.var(x), rel=1e-6)


# ---- the path


def walk(targets, cap):
    """Book after book with pandas."""
    book, out = pd.Series(dtype=float), {}
    for day, g in sorted(targets.groupby("rebalance_date")):
        goal = g.set_index("ts_code").weight
        old = book.reindex(goal.index).fillna(0.0)
        held = old.sum()
        if held > 0:
            old = old / held
            move = (goal - old).abs().sum() / 2
            book = old + min(1.0, cap / move if move > cap else 1.0) * (goal - old)
        else:
            book = goal
        out[day] = book[book > 0]
    return out


@pytest.mark.parametrize("rows_per_task", [5000, 7])
def test_path_is_the_walk_from_book_to_book(spark, rows_per_task):
    rng = np.random.default_rng(9)
    rows = []
    for s, days in (("x", range(30)), (None, range(3, 25, 2)), ("y,z", [4, 5, 29])):
        for k in days:
            codes = rng.choice(25, rng.integers(1, 20), replace=False)
            w = rng.random(len(codes)) * (rng.random(len(codes)) < 0.8)
            w = w / w.sum() if w.sum() else w + 1 / len(w)
            rows += [(s, dt.date(2021, 1, 1) + dt.timedelta(days=30 * k), int(c), float(v)) for c, v in zip(codes, w)]
    df = spark.createDataFrame(rows, "s string, rebalance_date date, ts_code int, weight double").repartition(3)
    caps = {"x": 0.1, "y,z": 0.5}
    got = tilt.turnover_path(df, Limits(max_turnover=0.25), ["s"], caps, rows_per_task).toPandas()
    frame = pd.DataFrame(rows, columns=["s", "rebalance_date", "ts_code", "weight"])
    seen = 0
    for s in ("x", None, "y,z"):
        own = frame[frame.s.isna() if s is None else frame.s == s]
        mine = got[got.s.isna() if s is None else got.s == s]
        want = walk(own, caps.get(s, 0.25))
        for day, book in want.items():
            have = mine[mine.rebalance_date == day].set_index("ts_code").weight
            assert set(have.index) == set(book.index) and np.allclose(have.sort_index(), book.sort_index(), atol=1e-12)
            seen += len(book)
    assert seen == len(got) and tilt.turnover_path(df.limit(0), by=["s"]).count() == 0


def test_external_series_are_joined_by_the_calendar(spark, small):
    d = fixtures.data(spark, small)
    rows = d.external().groupBy("trade_date").agg(*[F.countDistinct(c).alias(c) for c in ("m2_yoy", "northbound_net_inflow", "cn_spread_10y_2y")]).toPandas()
    assert (rows.iloc[:, 1:] <= 1).all().all() and rows.northbound_net_inflow.sum() > 100 and rows.cn_spread_10y_2y.sum() > 100
    assert d.external().count() == d.model().count() and conformal_rank(0.1) is not None
