"""Expanding-window backtests by month.

A fold is a key like a series: the states, bounds and exogenous means of all folds come from one plan over
the features, and one recursion carries all folds and strategies, each batch of it predicted by the models of its fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_null_safe
from ..functions.lineage import cut_lineage, scratch
from ..functions.parallel import side_by_side
from .evaluate import align, backtest_metrics
from .features import TARGETS, exogenous_columns, model_columns
from .forecast import by_key, ensemble_predictor, recursive_forecast, start_state
from .models import refit_ensemble

STRATEGIES = ("base", "month_end_boost")


def _first(month: str) -> Column:
    return F.to_date(F.lit(f"{month}-01"))


def check_months(features: DataFrame, months: Sequence[str]) -> None:
    """An error that names the first month that has no rows, or none before it; one pass for all months."""
    counts = features.agg(*(F.count_if(c).alias(f"{n}{i}") for i, m in enumerate(months) for n, c in (("in", F.trunc("date", "MM") == _first(m)), ("before", F.col("date") < _first(m))))).first()
    for i, m in enumerate(months):
        if not counts[f"in{i}"]:
            raise ValueError(f"{m} has no data")
        if not counts[f"before{i}"]:
            raise ValueError(f"there is no history before {m}")


def fold_states(features: DataFrame, months: Sequence[str], exogenous: Sequence[str] = (), series_cols: Sequence[str] = ()) -> DataFrame:
    """``(series, fold, last_date, h_purchase, h_redeem, bounds, exogenous)`` of each series that has rows in a fold's month and before it.

    The last values come from the rows before the fold, as do the bounds; the exogenous values are means over the
    month before it, and a series without a row there is an error, as nothing says what its rates were. Null is a series like
    any other. Rows go to their folds only to be cut to the last thirty; all else is aggregated by series, once for all folds.
    """
    keys = [*series_cols]
    firsts = F.array(*(F.struct(F.lit(m).alias("fold"), _first(m).alias("first")) for m in months))
    inside = features.select(*keys, F.date_format("date", "yyyy-MM").alias("fold")).where(F.col("fold").isin(list(months))).distinct()
    each = features.select(*keys, "date", *TARGETS, F.explode(F.filter(firsts, lambda f: F.col("date") < f["first"])).alias("__f")).select(*keys, "date", *TARGETS, "__f.fold")
    state = join_null_safe(start_state(each, [*keys, "fold"]), inside, [*keys, "fold"], "left_semi")
    shares = F.array(F.lit(0.01), F.lit(0.99))
    of_fold = []
    for m in months:
        before, month = F.col("date") < _first(m), F.trunc("date", "MM") == F.add_months(_first(m), -1)
        bounds = [F.percentile(F.when(before, F.col(t)), shares) for t in TARGETS]
        of_fold.append(F.struct(F.lit(m).alias("fold"), F.count_if(month).alias("__rows"), *(b.alias(f"__{t}") for t, b in zip(TARGETS, bounds, strict=True)),
                                *(F.avg(F.when(month, F.col(c))).alias(c) for c in exogenous)))
    known = features.groupBy(*keys).agg(F.array(*of_fold).alias("__of")).select(*keys, F.explode("__of").alias("__o")).select(*keys, "__o.*")
    name = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys))
    missing = F.raise_error(F.concat(F.lit("the month before "), F.col("fold"), F.lit(" has no rows: "), name)).cast("double")
    known = known.select(*keys, "fold", "__rows", *(F.col(f"__{t}")[i].alias(f"{t}_{n}") for t in TARGETS for i, n in enumerate(("lo", "hi"))), *exogenous)
    first = F.to_date(F.concat("fold", F.lit("-01")))
    joined = join_null_safe(state, known, [*keys, "fold"]).withColumn("last_date", F.date_sub(first, 1))
    return joined.withColumns({c: F.when(F.col("__rows") == 0, missing).otherwise(F.col(c)) for c in exogenous}).drop("__rows")


def backtest_predictions(features: DataFrame, months: Sequence[str], columns: Sequence[str] | None = None, series_cols: Sequence[str] = (), seeds: int = 1, threads: int = 4,
                         holiday_dates: Sequence[str] = (), predictor: Callable | None = None, **options) -> DataFrame:
    """Daily predictions and truths of the months (``yyyy-MM``), with ``fold`` and ``strategy``.

    Models see what is before their month only. Both strategies share them, as two copies of each series. An
    error where a month, or the history before it, has no rows. With ``predictor`` no models are fitted.
    """
    months = list(dict.fromkeys(months))
    check_months(features, months)
    columns = list(columns) if columns is not None else model_columns(features, series_cols)
    state = fold_states(features, months, exogenous_columns(columns, of=features), series_cols)
    iterations = {m: ["", ""] for m in months}
    if predictor is None:
        jobs = [(m, t) for m in months for t in TARGETS]
        refit = lambda j: refit_ensemble(features.where(F.col("date") < _first(j[0])), j[1], columns, seeds, series_cols=series_cols, **options)
        fitted = dict(zip(jobs, side_by_side(refit, jobs, threads), strict=True))
        iterations = {m: ["/".join(map(str, fitted[m, t].iterations)) for t in TARGETS] for m in months}
        predictor = by_key({m: ensemble_predictor(*(fitted[m, t] for t in TARGETS)) for m in months}, "fold")
        state = _with_fold_levels(state, fitted, series_cols)
    state = state.withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES)))).withColumn("boosted", F.col("strategy") == STRATEGIES[1])
    predicted = recursive_forecast(state, predictor, 31, [*series_cols, "fold", "strategy"], holiday_dates, boost_if="boosted", floor=None, shown=("fold",))
    predicted = predicted.where(F.date_format("date", "yyyy-MM") == F.col("fold"))  # months have up to 31 days
    found = F.create_map(*(x for m in months for x in (F.lit(m), F.array(*map(F.lit, iterations[m])))))
    out = align(predicted, features.where(F.date_format("date", "yyyy-MM").isin(months)), series_cols)
    return out.withColumns({f"{t}_best_iterations": found[F.col("fold")][i] for i, t in enumerate(TARGETS)})


def _with_fold_levels(state: DataFrame, fitted: dict, series_cols: Sequence[str]) -> DataFrame:
    """``state`` with the levels of its series as the models of its fold know them."""
    known = {t: [(m, e.levels) for (m, of), e in fitted.items() if of == t and e.levels] for t in TARGETS}
    for found in known.values():
        if found:
            table, (name,) = None, found[0][1].columns
            for m, levels in found:
                part = levels.table.withColumn("fold", F.lit(m))
                table = part if table is None else table.unionByName(part)
            overall = F.create_map(*(x for m, levels in found for x in (F.lit(m), F.lit(levels.overall[name]))))
            state = join_null_safe(state, table, [*series_cols, "fold"]).withColumn(name, F.coalesce(name, overall[F.col("fold")]))
    return state


def evaluate_fold(features: DataFrame, month: str, columns: Sequence[str] | None = None, series_cols: Sequence[str] = (), **options) -> DataFrame:
    """``backtest_predictions`` of one month."""
    return backtest_predictions(features, [month], columns, series_cols, **options)


def rolling_backtest(features: DataFrame, months: Sequence[str], series_cols: Sequence[str] = (), seeds: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """Predictions of all months, and their metrics by fold and strategy and over all days."""
    if seeds < 1:
        raise ValueError("seeds must be 1 or more")
    with scratch(features.sparkSession):  # the levels of series are read for the last time here
        predictions = cut_lineage(backtest_predictions(features, months, series_cols=series_cols, seeds=seeds, **options), keep=True)
    trained = predictions.groupBy("fold", "strategy").agg(F.max("purchase_best_iterations").alias("purchase_best_iterations"), F.max("redeem_best_iterations").alias("redeem_best_iterations"))
    metrics = backtest_metrics(predictions, series_cols).join(trained, ["fold", "strategy"], "left").fillna("", ["purchase_best_iterations", "redeem_best_iterations"])
    return predictions, metrics
