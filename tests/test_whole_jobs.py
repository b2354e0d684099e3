"""Queries do the whole job: all features, windows and rounds."""

import numpy as np
import pytest

from alphaloom.operators.conformal import calibration_split
from alphaloom.operators.training import LABEL, BoostParams, Scores, boosted_alpha, training_rows
from alphaloom.plans import studies
from checks import fixtures, q_model, q_studies


@pytest.mark.parametrize("build", [q_model.mod04b, q_model.mod05b])
def test_boosted_queries_fit_monthly_windows_at_default_settings(spark, small, build, monkeypatch):
    d, seen = fixtures.data(spark, small), []

    def recorded(panel, plan, features, label=None, min_train_rows=0, params=BoostParams()):
        seen.append((plan, features, params))
        return Scores(panel, panel)

    monkeypatch.setattr(q_model, "boosted_alpha", recorded)
    build(d)
    (plan, features, params), = seen
    assert tuple(features) == fixtures.FEATURES and params == BoostParams()
    months = [str(x.trade_date)[:7] for x in plan.targets.orderBy("trade_date").collect()]
    assert len(months) == len(set(months)) >= 20 and months == [f"{y}-{m:02}" for y in range(1990, 2010) for m in range(1, 13) if months[0] <= f"{y}-{m:02}" <= months[-1]]


def test_boosted_scores_are_staged_by_window(spark, small):
    d = fixtures.data(spark, small)
    plan = q_model.frozen_plan(d.model(), "1998-12-31", "1999-01-01")
    out = boosted_alpha(d.model(), plan, fixtures.FEATURES, min_train_rows=30, params=BoostParams(rounds=2)).predictions
    assert out.count() > 0 and "UDF" not in out._jdf.queryExecution().toString()


def test_full_variant_has_the_snapshots_of_the_composite(spark, small):
    d = fixtures.data(spark, small)
    got = studies.variant_snapshots(d.model().withColumn("benchmark_weight", d.model()["amount"]), q_studies.VARIANTS)
    key, value = ["rebalance_date", "ts_code"], ["benchmark_weight", "alpha_score", "score"]
    both = got.where("variant = 'full_factor'").toPandas().set_index(key)[value].join(d.prepared().toPandas().set_index(key)[value], how="outer", rsuffix="_want")
    assert len(both) and all(((both[c] - both[c + "_want"]).abs() < 1e-6).all() for c in value)


def test_every_variant_has_both_constructions(spark, small):
    rows = q_studies.exp07b(fixtures.data(spark, small)).collect()
    both = [(c, n) for c in ("constrained_optimizer", "rank_equal_weight") for n in q_studies.VARIANTS]
    assert sorted((r.portfolio_construction, r.variant) for r in rows) == sorted(both)
    assert all(r.information_ratio is not None for r in rows)


def test_frozen_conformal_fits_all_features(spark, small):
    """Scores are those of numpy's least squares on the rows outside the calibration set, intervals cover most of it."""
    d = fixtures.data(spark, small)
    plan, x = q_model.frozen_plan(d.model(), "1998-12-31", "1999-01-01"), list(fixtures.FEATURES)
    design = lambda df: np.column_stack([np.ones(len(df)), df[x].fillna(0.0)])
    rows = calibration_split(training_rows(d.model(), plan), fixtures.split_key()).select("is_calibration", LABEL, *x).toPandas()
    fit = rows[~rows.is_calibration]
    coef = np.linalg.lstsq(design(fit), fit[LABEL], rcond=None)[0]
    got = q_model.mod04d(d).select("trade_date", "ts_code", "ml_score", "ci_half_width").toPandas()
    both = got.merge(d.model().select("trade_date", "ts_code", *x).toPandas(), on=["trade_date", "ts_code"])
    assert len(both) == len(got) > 0 and np.allclose(both.ml_score, design(both) @ coef, atol=1e-8)
    calib = rows[rows.is_calibration]
    assert 0.85 < (abs(calib[LABEL] - design(calib) @ coef) <= got.ci_half_width.iloc[0]).mean() < 0.95
