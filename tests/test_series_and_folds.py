"""Series keys as inputs of models, boosting with patience, and folds as keys of one recursion."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideflow.functions.lineage import cut_lineage, scratch
from tideflow.operators import backtest, evaluate, features, forecast, models, series_key


def panel(spark, levels, n=120, start=dt.date(2001, 1, 1), **columns):
    """Series that differ by their level alone."""
    rows = [(s, start + dt.timedelta(i), int(v * (100 + i % 7)), int(2 * v * (100 + i % 7))) for s, v in levels.items() for i in range(n)]
    return spark.createDataFrame(rows, "series string, date date, purchase long, redeem long").withColumns({"x": F.weekday("date") * 1.0, **columns})


def test_levels_leave_out_the_fold_of_a_row(spark):
    rows = panel(spark, {"low": 1, "high": 50, None: 7}, n=100)
    levels, numbered = series_key.fit_levels(rows, ["series"], ["purchase"], prior=3.0, folds=4)
    got = numbered.select("series", "date", "purchase", F.pmod(F.hash(F.trunc("date", "MM")), F.lit(4)).alias("fold"), "purchase_series_level").collect()
    overall = np.mean([np.log1p(r.purchase) for r in got])
    assert numbered.count() == 300 and levels.overall == {"purchase_series_level": pytest.approx(overall)}
    for r in got:
        rest = [np.log1p(o.purchase) for o in got if o.series == r.series and o.fold != r.fold]
        assert r.purchase_series_level == pytest.approx((sum(rest) + 3 * overall) / (len(rest) + 3))
    asked = spark.createDataFrame([("low",), ("never seen",), (None,)], "series string")
    served = {r.series: r.purchase_series_level for r in levels.apply(asked).collect()}
    of = lambda s: [np.log1p(r.purchase) for r in got if r.series == s]
    assert served == {s: pytest.approx((sum(of(s)) + 3 * overall) / (len(of(s)) + 3)) for s in ("low", None)} | {"never seen": pytest.approx(overall)}
    empty, none = series_key.fit_levels(rows.limit(0), ["series"], ["purchase", "redeem"])
    assert none.count() == 0 and empty.apply(asked).select(*empty.columns).distinct().collect() == [(0.0, 0.0)]


def test_a_model_tells_series_apart_by_their_level(spark, tmp_path):
    rows = panel(spark, {"low": 1, "high": 50, None: 7}).cache()
    blind = models.fit_one(rows, "purchase", ["x"], trees=5, depth=3)
    seeing = models.fit_one(rows, "purchase", ["x"], ["series"], trees=5, depth=3)
    assert blind.columns == ["x"] and seeing.columns == ["x", "purchase_series_level"]
    mean = lambda e, s: e.predict(rows, "p").where(F.col("series").eqNullSafe(s)).agg(F.avg("p")).first()[0]
    assert mean(blind, "low") == pytest.approx(mean(blind, "high"))
    for s, level in (("low", 103), ("high", 5150), (None, 721)):
        assert mean(seeing, s) == pytest.approx(level, rel=0.1)
    assert "purchase_series_level" not in seeing.predict(rows, "p").columns
    seeing.save(str(tmp_path / "m"))
    back = models.Ensemble.load(str(tmp_path / "m"))
    asked = rows.limit(3).withColumn("series", F.lit("never seen"))
    assert back.levels.overall == seeing.levels.overall and [r.p for r in back.predict(asked, "p").collect()] == [r.p for r in seeing.predict(asked, "p").collect()]
    # and in the recursion
    other = models.fit_one(rows, "redeem", ["x"], ["series"], trees=5, depth=3)
    state = forecast.with_bounds(forecast.start_state(rows, ["series"]), rows, ["series"]).withColumn("x", F.lit(3.0))
    state = forecast.with_levels(state, seeing, other)
    carried = forecast.recursive_forecast(state, forecast.ensemble_predictor(seeing, other), 3, ["series"])
    got = {r.series: (r.p, r.r) for r in carried.groupBy("series").agg(F.avg("purchase_pred").alias("p"), F.avg("redeem_pred").alias("r")).collect()}
    assert got["low"][0] < 150 < 600 < got[None][0] < 900 < 4000 < got["high"][0] and got["low"][1] == pytest.approx(2 * got["low"][0], rel=0.1)


def test_boosting_ends_with_patience(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(dt.date(2001, 1, 1) + dt.timedelta(i), int(1000 * (i % 7) + rng.integers(0, 30)), float(i % 7), float(rng.random())) for i in range(150)]
    df = spark.createDataFrame(rows, "date date, purchase long, x double, noise double").cache()
    train, tune = df.where("date < '2001-05-01'"), df.where("date >= '2001-05-01'")
    frame = models.training_rows(train, "purchase", ["x", "noise"])
    tuned = models.tuning_rows(tune, "purchase", frame)
    model, fitted = models.boost_in_rounds(frame.frame, tuned, patience=2, trees=40, depth=3, seed=5)
    errors = model.evaluateEachIteration(tuned, "squared")
    assert fitted < 40 and model.getNumTrees == fitted - 2 and min(errors) == errors[-1]
    assert model.treeWeights == [1.0] + [0.1] * (model.getNumTrees - 1)
    assert models.boost_in_rounds(frame.frame, tuned, patience=50, trees=3, depth=3)[1] == 3
    # a model grown in rounds is about as good as one fitted at once
    whole = models.make_regressor(trees=model.getNumTrees, depth=3, seed=5).fit(frame.frame)
    assert errors[-1] < 1.5 * whole.evaluateEachIteration(tuned, "squared")[-1] + 1e-3
    frame.release()
    asked, grow = [], models.boost_in_rounds
    monkeypatch.setattr(models, "boost_in_rounds", lambda *a, **k: asked.append(grow(*a, **k)) or asked[-1])
    stopped = models.fit_ensemble(train, "purchase", ["x", "noise"], seeds=2, trees=30, depth=3, valid=tune, patience=2)
    assert len(asked) == 2 and all(n < 30 for _, n in asked) and sorted(stopped.iterations) == sorted(m.getNumTrees for m, _ in asked)
    refitted = models.refit_ensemble(df, "purchase", ["x"], trees=12, depth=2, patience=1)
    assert len(asked) == 3 and refitted.iterations == [asked[2][0].getNumTrees]
    models.fit_ensemble(train, "purchase", ["x"], seeds=1, trees=3, depth=2, valid=tune)  # patience 100 cannot act on 3 trees
    assert len(asked) == 3


_stub = lambda found: (found["purchase_lag_7"] + found.get("rate", 0.0), found["redeem_lag_7"])


def test_folds_are_keys_of_one_recursion(spark, monkeypatch):
    rows = panel(spark, {"a": 1, None: 3}, n=150, rate=F.month("date") * 10.0)
    calls, run = [], backtest.recursive_forecast
    monkeypatch.setattr(backtest, "recursive_forecast", lambda *a, **k: calls.append(1) or run(*a, **k))
    months = ["2001-03", "2001-04", "2001-05"]
    together = backtest.backtest_predictions(rows, months, ["rate"], ["series"], predictor=_stub)
    key = ["series", "fold", "strategy", "date"]
    got = {tuple(r[k] for k in key): (r.purchase_pred, r.redeem_pred, r.purchase_true) for r in together.collect()}
    assert len(calls) == 1 and len(got) == together.count() == 2 * 2 * (31 + 30 + 30)  # May has thirty days of data
    assert {k[0] for k in got} == {"a", None} and all(k[3].strftime("%Y-%m") == k[1] for k in got)
    for month in months:  # each fold as by itself, from its own state
        first = dt.date(int(month[:4]), int(month[5:]), 1)
        history = rows.where(F.col("date") < first)
        state = forecast.with_exogenous(forecast.with_bounds(forecast.start_state(history, ["series"]), history, ["series"]), history, ["rate"], ["series"])
        assert {r.rate for r in state.collect()} == {(first.month - 1) * 10.0}
        for r in forecast.recursive_forecast(state, _stub, 28, ["series"], (), floor=None).collect():
            if (r.series, month, "month_end_boost", r.date) in got:
                assert got[r.series, month, "month_end_boost", r.date][:2] == (r.purchase_pred, r.redeem_pred)
    predictions, metrics = backtest.rolling_backtest(rows.drop("rate"), months, ["series"], predictor=_stub)
    assert predictions.count() == len(got) and metrics.where("series IS NULL AND fold = 'overall'").count() == 2
    assert metrics.select("series", "fold", "strategy").distinct().count() == 2 * 2 * 4


def test_rates_come_from_the_month_before_the_fold(spark):
    rows = panel(spark, {"a": 1, "gone": 2}, n=150, rate=F.month("date") * 10.0)
    ended = rows.where("series = 'a' OR date < '2001-02-10'")  # nothing of it is to be forecast in May
    assert backtest.backtest_predictions(ended, ["2001-05"], ["rate"], ["series"], predictor=_stub).select("series").distinct().collect() == [("a",)]
    back = rows.where("series = 'a' OR date < '2001-02-10' OR date >= '2001-05-05'")  # again there, but without rates in April
    with pytest.raises(Exception, match="the month before 2001-05 has no rows: gone"):
        backtest.backtest_predictions(back, ["2001-05"], ["rate"], ["series"], predictor=_stub).collect()
    with pytest.raises(ValueError, match="2001-07 has no data"):
        backtest.backtest_predictions(rows, ["2001-05", "2001-07"], [], ["series"], predictor=_stub)
    unknown = rows.where("series = 'a'").drop("series").withColumn("rate", F.lit(None).cast("double"))
    state = forecast.with_exogenous(forecast.start_state(unknown), unknown, ["rate"])
    assert state.first().rate is None  # the month has rows, if none with a rate


def test_a_backtest_with_models(spark):
    rows = panel(spark, {"a": 1, "b": 20}, n=120)
    predictions, metrics = backtest.rolling_backtest(rows, ["2001-03", "2001-04"], ["series"], columns=["x"], trees=3, depth=2)
    off = predictions.agg(F.avg(F.abs(F.col("purchase_pred") - F.col("purchase_true")) / F.col("purchase_true"))).first()[0]
    assert off < 0.25 and predictions.select("series", "fold", "strategy").distinct().count() == 8
    found = {r.fold: r.purchase_best_iterations for r in metrics.collect()}
    assert set(found) == {"2001-03", "2001-04", "overall"} and found["overall"] == "" and 1 <= int(found["2001-03"]) <= 3


def test_null_keys_are_aligned(spark):
    rows = spark.createDataFrame([(None, dt.date(2001, 1, 1), 1, 2), ("a", dt.date(2001, 1, 1), 3, 4), ("a", None, 5, 6)], "series string, date date, purchase long, redeem long")
    predicted = rows.select("series", "date", F.col("purchase").alias("purchase_pred"), F.col("redeem").alias("redeem_pred"))
    assert {(r.series, r.purchase_pred, r.redeem_true) for r in evaluate.align(predicted, rows, ["series"]).collect()} == {(None, 1, 2), ("a", 3, 4), ("a", 5, 6)}


def test_filled_days_leave_rates_unknown(spark):
    rows = [(dt.date(2001, 1, 1) + dt.timedelta(i), 10, 5, None if i % 3 == 0 else 100.0 + i) for i in range(40) if i not in (7, 8, 20)]
    daily = spark.createDataFrame(rows, "date date, purchase long, redeem long, rate double")
    filled = {r.date.day + 31 * (r.date.month - 1) - 1: r for r in features.fill_calendar(daily).collect()}
    assert len(filled) == 40 and all((filled[i].purchase, filled[i].redeem, filled[i].rate) == (0, 0, None) for i in (7, 8, 20)) and filled[9].rate is None
    table = {r.date.day + 31 * (r.date.month - 1) - 1: r.rate for r in features.add_features(daily, calendar_gaps="fill").collect()}
    last = 101.0
    for i in range(40):
        last = 100.0 + i if i % 3 and i not in (7, 8, 20) else last
        assert table[i] == last


def test_validation_keeps_the_series(spark):
    rows = panel(spark, {"a": 1, None: 20}, n=60)
    got = models.one_step_validation(rows.where("date < '2001-02-20'"), rows.where("date >= '2001-02-20'"), ["x"], series_cols=["series"], trees=2, depth=2)
    assert got.columns[:2] == ["series", "date"] and got.select("series", "date").distinct().count() == got.count() == 20


def test_scratch_deletes_what_was_cut_inside(spark):
    import os

    with scratch(spark) as folder:
        inner = cut_lineage(spark.range(3))
        with scratch(spark) as deeper:
            kept = cut_lineage(spark.range(4), keep=True)
        assert inner.count() == 3 and kept.count() == 4 and not os.path.exists(deeper)
        stays = cut_lineage(spark.range(5), keep=True)
    assert not os.path.exists(folder) and stays.count() == 5
