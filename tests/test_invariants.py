"""Properties that hold whatever the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import risk, tilt
from alphaloom.operators.joins import members_only
from alphaloom.operators.training import rolling_plan
from checks.fixtures import EMBARGO, data
from checks.q_portfolio import LIMITS, base_tilt, history


@pytest.fixture(scope="module")
def d(spark):
    return data(spark, "/root/testdata/sf0.01")


def test_books_are_fully_invested_and_turnover_is_bounded(d):
    rows = d.book().groupBy("rebalance_date").agg(F.sum("weight").alias("w"), F.min("weight").alias("lo"), F.max("turnover").alias("t")).collect()
    assert all(abs(x.w - 1) < 1e-9 and x.lo > 0 and 0 <= x.t <= 1 + 1e-9 for x in rows)


def test_nav_is_positive(d):
    assert d.nav().where("portfolio_nav <= 0 OR benchmark_nav <= 0").count() == 0


def test_no_training_label_is_realised_after_its_predict_date(d):
    plan = rolling_plan(d.model(), 12, EMBARGO)
    cal = d.model().select("trade_date").distinct().orderBy("trade_date").toPandas()["trade_date"].tolist()
    at = {x: i for i, x in enumerate(cal)}
    last = plan.windows.groupBy("window_id").agg(F.max("trade_date").alias("d")).collect()
    assert last and all(at[x.d] + EMBARGO <= at[x.window_id] for x in last)


def test_point_in_time_rows_are_members(d):
    kept = members_only(d.bars(), d.membership()).select("ts_code", F.date_trunc("month", "trade_date").cast("date").alias("month")).distinct()
    assert kept.join(d.membership(), ["ts_code", "month"], "left_anti").count() == 0


def test_tilts_meet_every_limit(d):
    h, s = history(d)
    rows = base_tilt(d)
    diag = risk.diagnostics(rows, h, s)
    ok = risk.check_constraints(rows, diag, LIMITS).join(rows.select("rebalance_date", "optimization_status").distinct(), "rebalance_date")
    bad = ok.where("optimization_status = 'tilted' AND NOT (fully_invested AND weight_ok AND tracking_ok AND industry_ok)")
    assert ok.count() > 50 and bad.count() == 0


def test_path_matches_a_plain_walk(d):
    """Brute force over dates: cut to the snapshot, rescale, move by at most the limit."""
    targets = base_tilt(d).select("rebalance_date", "ts_code", "weight").toPandas()
    path = tilt.turnover_path(base_tilt(d).select("rebalance_date", "ts_code", "weight"), LIMITS).toPandas()
    got = {k: g.set_index("ts_code").weight for k, g in path.groupby("rebalance_date")}
    book = None
    for day, g in targets.groupby("rebalance_date"):
        goal = g.set_index("ts_code").weight
        old = book.reindex(goal.index).fillna(0.0) if book is not None else goal * 0
        if old.sum() > 0:
            old = old / old.sum()
            move = (goal - old).abs().sum() / 2
            goal = old + min(1.0, LIMITS.max_turnover / move if move else 1.0) * (goal - old)
        book = goal
        assert book.sum() == pytest.approx(1.0)
        assert np.allclose(got[day].reindex(book.index).fillna(0.0), book, atol=1e-10)


def test_shrinkage_matches_the_textbook_estimator(d):
    h, s = history(d)
    pdf, sh = h.toPandas(), s.toPandas().set_index("rebalance_date")
    codes = d.prepared().select("rebalance_date", "ts_code").toPandas()
    for day in sorted(sh.index)[10:14]:
        names = sorted(codes[codes.rebalance_date == day].ts_code)
        x = pdf[pdf.rebalance_date == day].pivot(index="t", columns="ts_code", values="x").reindex(columns=names).fillna(0.0).to_numpy()
        x = x - x.mean(axis=0)
        n, p = x.shape
        cov = x.T @ x / n
        mu = np.trace(cov) / p
        delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
        beta = min(((x**2).T @ (x**2) / n - cov**2).sum() / (n * p), delta)
        assert sh.loc[day, "mu"] == pytest.approx(mu) and sh.loc[day, "shrink"] == pytest.approx(beta / delta)


def test_row_order_and_partitioning_do_not_matter(spark, d):
    from alphaloom.operators.cross_section import model_panel

    base = d.labeled().select("ts_code", "trade_date", "industry_name", "ret_20")
    mixed = base.repartition(13, "ret_20").orderBy(F.col("ret_20").desc())
    a, b = (model_panel(x, ["ret_20"]).select("ts_code", "trade_date", F.round("ret_20", 9).alias("z")) for x in (base, mixed))
    assert a.exceptAll(b).count() == 0


def test_a_future_day_changes_no_past_factor(spark, d):
    from alphaloom.operators.factors import compute_factors

    cut = d.bars().where("trade_date <= DATE'1999-12-31'")
    cols = ("ts_code", "trade_date", "ret_20", "volatility_20", "turnover_20")
    full = compute_factors(d.bars()).where("trade_date <= DATE'1999-12-31'").select(*cols)
    assert compute_factors(cut).select(*cols).exceptAll(full).count() == 0


def test_least_squares_matches_numpy(d):
    from alphaloom.operators.training import LABEL, fit_rows, features_or_zero, training_rows

    cols = ["ret_20", "volatility_20", "turnover_20"]
    plan = rolling_plan(d.model(), 12, EMBARGO)
    rows = training_rows(d.model(), plan)
    coef = fit_rows(rows, features_or_zero(cols), F.col(LABEL)).toPandas().set_index("window_id")
    day = sorted(coef.index)[20]
    one = rows.where(F.col("window_id") == F.lit(day)).select(*cols, LABEL).toPandas().fillna({c: 0.0 for c in cols})
    x = np.column_stack([np.ones(len(one)), one[cols].to_numpy()])
    want = np.linalg.lstsq(x, one[LABEL].to_numpy(), rcond=None)[0]
    assert np.allclose(coef.loc[day, "coef"], want, atol=1e-8)
