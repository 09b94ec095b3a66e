"""The model queries run the whole job of their operators: all trees, seeds, targets and months."""

import inspect

import pytest

from tideflow.operators import models
from tideflow.plans import catalogue

BOOSTED, FOREST = (("boosted", 30, 5), ("forest", 30, 15))


@pytest.fixture(scope="module")
def panel(spark, data_dir):
    rows, _ = catalogue._panel(spark, data_dir)
    return rows.where("date >= '2001-01-01'").cache(), ["purchase_lag_1", "redeem_lag_1"]


@pytest.fixture
def asked(monkeypatch, panel):
    """The (kind, trees, depth, seed) that queries ask for; one small tree is fitted instead."""
    got, make = [], models.make_regressor

    def record(*args, **options):
        bound = inspect.signature(make).bind(*args, **options)
        bound.apply_defaults()
        a = bound.arguments
        kind = models._KINDS[a["kind"].lower()]
        got.append((kind, a["trees"], a["depth"] or (15 if kind == models.FOREST else 5), a["seed"]))
        return make(kind=a["kind"], trees=1, depth=1, seed=a["seed"])

    monkeypatch.setattr(models, "make_regressor", record)
    monkeypatch.setattr(catalogue, "_panel", lambda spark, sf_dir: panel)
    return got


@pytest.mark.parametrize(("name", "model", "seeds"), [
    ("seed_ensemble", BOOSTED, [42, 43, 44]), ("gbt_forecast", BOOSTED, [42]), ("rf_forecast", FOREST, [42]), ("loss_curve", BOOSTED, [42, 142]),
    ("one_step_validation", BOOSTED, [42, 142]), ("time_series_cv", BOOSTED, [43, 44, 45, 143, 144, 145])])
def test_trees_and_seeds(spark, asked, name, model, seeds):
    out = catalogue.queries()[name](spark, "unused")
    assert sorted(asked) == sorted((*model, s) for s in seeds)
    if name == "loss_curve":
        assert [tuple(r) for r in out.select("target", "trees").collect()] == [(t, k) for t in ("purchase", "redeem") for k in (6, 12, 18, 24, 30)]


@pytest.mark.parametrize("name", ["recursive_forecast", "forecast_submission"])
def test_three_seeds_forecast_both_targets(spark, asked, monkeypatch, name):
    monkeypatch.setattr(catalogue.forecast, "recursive_forecast", lambda state, predict, days, *_: state.selectExpr("segment", f"date_add(last_date, {days}) AS date", "0.0 AS purchase_pred", "0.0 AS redeem_pred"))
    catalogue.queries()[name](spark, "unused")
    assert sorted(asked) == sorted([(*BOOSTED, s) for s in (42, 43, 44)] * 2)


def test_five_months_are_tested(spark, asked, monkeypatch):
    got = {}

    def record(features, months, series_cols=(), **options):
        got.update(options, months=list(months))
        return features, features.limit(1)

    monkeypatch.setattr(catalogue.backtest, "rolling_backtest", record)
    catalogue.queries()["rolling_backtest"](spark, "unused")
    assert got["months"] == [f"2001-0{m}" for m in range(2, 7)]
    assert not {"trees", "depth"} & set(got)
