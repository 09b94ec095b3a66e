import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideflow.operators import backtest, features, forecast, models
from tideflow.plans import catalogue
from tideflow.sources import sinks


def days(spark, values, start=dt.date(2001, 1, 1), skip=()):
    rows = [(start + dt.timedelta(i), v, 2 * v if v is not None else None) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "date date, purchase long, redeem long")


def test_feature_names_and_count(spark, data_dir):
    got = catalogue.queries()["daily_features"](spark, data_dir)
    rates = 5
    assert len(got.columns) == 3 + 110 - 10 + rates
    exogenous = features.exogenous_columns(features.model_columns(got))
    assert set(exogenous) == {"mfd_daily_yield", "mfd_7daily_yield", "Interest_1", "Interest_2", "Interest_3"}
    assert "purchase_month_start_mean" in features.exogenous_columns(features.model_columns(got), freeze_month_mean=True)
    assert "user_count" in features.model_columns(got, same_day_counts=True)
    assert got.where("purchase_roll_std_30 IS NULL").isEmpty()


def test_windows_are_by_row_and_need_to_be_full(spark):
    df = days(spark, [1, 2, None, 4, 5, 6, 7], skip=(1,))
    got = {r.date.day: r for r in df.select("date", *(c.alias(n) for n, c in (features.lags() | features.rolling() | features.rolling_median()).items())).collect()}
    assert got[3].purchase_lag_1 == 1  # 2 January is missing: the row before counts
    assert got[7].purchase_roll_mean_3 == 5 and got[7].purchase_roll_median_3 == 5 and got[7].purchase_roll_std_3 == 1
    assert got[6].purchase_roll_mean_3 is None and got[4].purchase_roll_min_3 is None


def test_fill_missing_and_calendar(spark):
    df = spark.createDataFrame([(dt.date(2001, 1, i + 1), v, None) for i, v in enumerate([None, 2.0, None, 4.0])], "date date, a double, b double")
    assert [tuple(r)[1:] for r in features.fill_missing(df).orderBy("date").collect()] == [(2.0, 0.0), (2.0, 0.0), (2.0, 0.0), (4.0, 0.0)]
    assert features.fill_calendar(days(spark, range(5), skip=(2,))).count() == 5


def test_later_days_do_not_change_a_feature(spark):
    values = [(i * 37) % 101 for i in range(45)]
    table = [features.add_features(days(spark, v), calendar_gaps="rows").where("date <= '2001-02-05'").orderBy("date") for v in (values, values[:36] + [999] * 9)]
    names = [c for c in table[0].columns if c not in ("purchase", "redeem")]
    head = [t.where("date > '2001-02-01'").select(*names).collect() for t in table]
    assert head[0] == head[1]


def test_serving_equals_training_but_for_the_deviation(spark):
    values = [(i * 37) % 101 + 1 for i in range(41)]
    trained = days(spark, values).select("date", *(c.alias(n) for n, c in (features.lags() | features.rolling() | features.rolling_median() | features.month_start_mean() | features.same_period() | features.ratio_diff()).items())).orderBy(F.desc("date")).first().asDict()
    state = forecast.start_state(days(spark, values[:-1]))
    served = state.select(*(c.alias(n) for n, c in forecast.serving_features().items())).first().asDict()
    sample = state.select(*(c.alias(n) for n, c in forecast.serving_features(ddof=1).items())).first().asDict()
    for name, value in served.items():
        n = int(name.rsplit("_", 1)[1]) if "roll_std" in name else 0
        assert value * (math.sqrt(n / (n - 1)) if n else 1) == pytest.approx(float(trained[name])), name
        assert sample[name] == pytest.approx(float(trained[name])), name


@pytest.mark.parametrize("n", [1, 2, 6, 8, 29])
def test_serving_falls_back_on_short_histories(spark, n):
    values = list(range(5, 5 + n))
    got = forecast.start_state(days(spark, values)).select(*(c.alias(k) for k, c in forecast.serving_features().items())).first()
    assert got.purchase_same_day_last_month == 0 and got.purchase_lag_30 == values[-1]
    assert got.purchase_lag_3 == (values[-3] if n >= 3 else values[-1]) and got.purchase_roll_mean_7 == pytest.approx(sum(values[-7:]) / len(values[-7:]))


def test_recursion_with_a_stub_model(spark):
    values = [100 + (i % 7) for i in range(59)]  # up to 28 February
    history = days(spark, values)
    state = forecast.with_bounds(forecast.start_state(history), history).withColumn("strategy", F.explode(F.array(F.lit("base"), F.lit("boost")))).withColumn("boosted", F.col("strategy") == "boost").withColumn("last_date", F.lit("2001-02-24").cast("date"))
    got = forecast.recursive_forecast(state, lambda f: (f["purchase_lag_1"], f["redeem_lag_1"]), 5, ["strategy"], boost_if="boosted", batch_series=1)
    low, high = 100.0, 106.0
    for strategy in ("base", "boost"):
        h, expected = [float(v) for v in values], []
        for k in range(1, 6):
            day = dt.date(2001, 2, 24) + dt.timedelta(k)
            p = 0.99 * h[-1] + 0.01 * sum(h[-7:]) / 7
            if strategy == "boost" and day.month == 2 and day.day >= 26:
                p *= 1.2
            h.append(max(0.0, min(max(p, low), high)))
            expected.append(h[-1])
        assert [r.purchase_pred for r in got.where(F.col("strategy") == strategy).orderBy("date").collect()] == pytest.approx(expected)


def test_batches_are_served_as_plans_are(spark):
    """The features of the recursion equal the columns of ``serving_features`` and of the calendar, for histories of any length."""
    rows = [(f"s{n}", dt.date(2001, 1, 1) + dt.timedelta(i), (i * 37) % 101 + n, (i * 53) % 89) for n in (1, 2, 6, 8, 29, 30, 31, 45) for i in range(n)]
    rows += [(None, dt.date(2001, 2, 26) + dt.timedelta(i), 5 * i, -1) for i in range(3)]  # a null series; the ratio has 0 below
    history = spark.createDataFrame(rows, "series string, date date, purchase long, redeem long")
    state = forecast.with_bounds(forecast.start_state(history, ["series"]), history, ["series"]).withColumn("rate", F.lit(1.5))
    seen = []
    seen_by = lambda f: seen.append(f) or (f["purchase_lag_1"], f["redeem_lag_1"])
    local = state.coalesce(1).sortWithinPartitions("series").toArrow().to_batches()
    for ddof in (0, 1):
        expected = state.withColumn("date", F.date_add("last_date", 1)).select("series", *(c.cast("double").alias(n) for n, c in (features.calendar_features() | forecast.serving_features(ddof)).items())).orderBy("series").collect()
        h, sizes = forecast._padded(local[0].column("h_purchase"), 30)
        other, _ = forecast._padded(local[0].column("h_redeem"), 30)
        served = forecast._served({"purchase": h, "redeem": other}, sizes, ddof)
        assert set(served) == set(forecast.serving_features())
        for i, row in enumerate(expected):
            for name, values in served.items():
                got = None if math.isnan(values[i]) else values[i]
                assert got == (None if row[name] is None else pytest.approx(row[name])), (row.series, name)
    out = forecast.recursive_forecast(state, lambda f: (f["days_to_month_end"] + f["rate"], f["dayofweek_sin"] + f["purchase_lag_1"] * 0), 3, ["series"], smooth=1.0, boosts=(1.0, 1.0))
    assert out.groupBy("series").count().where("count = 3").count() == 9 and out.columns == ["series", "date", "purchase_pred", "redeem_pred"]
    assert not seen and seen_by  # features are handed over inside of tasks


def test_series_with_null_keys_and_without_history(spark):
    rows = spark.createDataFrame([(s, dt.date(2001, 1, d), 10 * d, d) for s in ("a", None) for d in (1, 2, 5)], "series string, date date, purchase long, redeem long")
    filled = features.fill_calendar(rows, ["series"])
    assert sorted((r.series or "", r.date.day, r.purchase) for r in filled.collect()) == [(s, d, 10 * d if d in (1, 2, 5) else 0) for s in ("", "a") for d in range(1, 6)]
    state = forecast.start_state(rows, ["series"])
    ready = forecast.with_exogenous(forecast.with_bounds(state, rows, ["series"]), rows.withColumn("rate", F.col("redeem") * 1.0), ["rate"], ["series"])
    assert [(r.series, r.rate, round(r.purchase_hi)) for r in ready.orderBy("series").collect()] == [(None, 8 / 3, 49), ("a", 8 / 3, 49)]
    with pytest.raises(Exception, match="there is no history: null"):
        forecast.with_bounds(state, rows.where("series = 'a'"), ["series"]).collect()
    with pytest.raises(Exception, match="the month before the forecast has no rows: a"):
        forecast.with_exogenous(state, rows.where("series IS NULL"), ["redeem"], ["series"]).collect()


def test_arrays_of_trees_predict_as_spark_does(spark):
    rows = days(spark, [(i * 37) % 101 for i in range(90)]).withColumns({"x": F.dayofmonth("date") * 1.0, "y": F.when(F.weekday("date") > 1, F.weekday("date") * 1.0), "z": F.lit(float("nan"))}).cache()
    x = np.array([[r.x, np.nan if r.y is None else r.y, r.z] for r in rows.orderBy("date").collect()])
    valid = rows.where("date >= '2001-03-01'")
    for ensemble in (models.fit_ensemble(rows, "purchase", ["x", "y", "z"], seeds=2, trees=6, depth=3, valid=valid), models.fit_ensemble(rows, "purchase", ["x", "y", "z"], seeds=1, trees=4, depth=3, forest_weight=0.3),
                     models.fit_one(rows, "redeem", ["x", "y", "z"], kind="forest", trees=5, depth=4)):
        assert ensemble.flat().predict(x) == pytest.approx([r.p for r in ensemble.predict(rows, "p").orderBy("date").collect()])


def test_early_stopping_keeps_the_first_trees(spark):
    rows = days(spark, [(i * 37) % 101 for i in range(90)]).withColumns({"x": F.dayofmonth("date") * 1.0, "y": F.weekday("date") * 1.0}).cache()
    whole = models.fit_one(rows, "purchase", ["x", "y"], trees=8, depth=3).models[0]
    tune = rows.where("date >= '2001-03-20'")
    best = models.best_iteration(whole, tune, "purchase", ["x", "y"])
    stopped = models.fit_ensemble(rows, "purchase", ["x", "y"], seeds=1, trees=8, depth=3, valid=tune)
    assert stopped.iterations == [best] and stopped.models[0].getNumTrees == best
    assert models.first_trees(whole, 2).toDebugString.count("Tree ") == 2

    class Errors:
        def __init__(self, errors):
            self.evaluateEachIteration = lambda df, loss: errors

    assert models.best_iteration(Errors([5.0, 3.0, 4.0, 4.0, 1.0]), tune, "purchase", ["x", "y"]) == 5
    assert models.best_iteration(Errors([5.0, 3.0, 4.0, 4.0, 1.0]), tune, "purchase", ["x", "y"], patience=2) == 2


def test_a_history_of_one_month_cannot_be_divided(spark):
    rows = days(spark, list(range(1, 29))).withColumn("x", F.dayofmonth("date"))
    with pytest.raises(ValueError, match="one month only"):
        models.refit_ensemble(rows, "purchase", ["x"], trees=2, depth=2)


def test_model_kinds_and_reload(spark, tmp_path):
    with pytest.raises(ValueError):
        models.make_regressor("linear")
    assert type(models.make_regressor("LightGBM")).__name__ == "GBTRegressor" and models.make_regressor("RandomForest").getMaxDepth() == 15
    rows = days(spark, [(i * 37) % 101 for i in range(60)]).withColumns({"x": F.dayofmonth("date"), "y": F.weekday("date")}).cache()
    fitted = models.fit_ensemble(rows, "purchase", ["x", "y"], seeds=2, trees=3, depth=2)
    fitted.save(str(tmp_path / "m"))
    ask = lambda e: [r.p for r in e.predict(rows, "p").orderBy("date").collect()]
    assert ask(fitted) == ask(models.Ensemble.load(str(tmp_path / "m"))) == ask(models.fit_ensemble(rows, "purchase", ["x", "y"], seeds=2, trees=3, depth=2))
    both = models.fit_ensemble(rows, "purchase", ["x", "y"], seeds=2, trees=3, depth=2, forest_weight=0.4, valid=rows)
    both.save(str(tmp_path / "both"))
    back = models.Ensemble.load(str(tmp_path / "both"))
    assert ask(both) == ask(back) != ask(fitted) and (back.columns, back.weights, back.iterations) == (both.columns, (1.0, 0.4), both.iterations)
    assert 1 <= models.refit_ensemble(rows, "purchase", ["x", "y"], trees=3, depth=2).iterations[0] <= 3


def test_backtest_errors_and_stub_fold(spark, tmp_path):
    rows = days(spark, [100 + (i % 7) for i in range(100)])
    stub = lambda f: (f["purchase_lag_1"], f["redeem_lag_1"])
    with pytest.raises(ValueError, match="no data"):
        backtest.evaluate_fold(rows, "2002-01", [], predictor=stub)
    with pytest.raises(ValueError, match="no history"):
        backtest.evaluate_fold(rows, "2001-01", [], predictor=stub)
    got = backtest.evaluate_fold(rows, "2001-03", [], predictor=stub)
    assert got.count() == 62 and got.select("date", "strategy").distinct().count() == 62
    sinks.write_folds(got, str(tmp_path / "folds"))
    assert spark.read.parquet(str(tmp_path / "folds")).count() == 62
    sinks.write_csv(got, str(tmp_path / "validation"))
    back = spark.read.csv(str(tmp_path / "validation"), header=True)
    assert back.columns == got.columns and back.count() == 62
    with pytest.raises(ValueError):
        backtest.rolling_backtest(rows, ["2001-03"], seeds=0)


def test_feature_table_round_trip(spark, tmp_path):
    table = features.add_features(days(spark, range(40)))
    sinks.write_features(table, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 40 and back.select("month_key").distinct().count() == 2
