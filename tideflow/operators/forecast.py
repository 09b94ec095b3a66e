"""Recursive forecasts of many series at once.

The state is one row for each series: its last values as arrays, its exogenous values and bounds. One
stage maps batches of series over the whole horizon: a step turns the state into the next day's features,
lets the models predict all series of the batch together, and appends the predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType

from ..functions import calendar as cal
from ..functions.joins import join_null_safe
from .features import LAGS, TARGETS, WINDOWS, clip_bounds, mean_of_present

KEEP = 30
#: Values of each feature by series, to the raw predictions of both targets by series.
Predictor = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]


def by_key(predictors: dict[object, Predictor], key: str) -> Predictor:
    """A predictor for batches whose rows have models of their own, by the value of the column ``key``."""

    def predict(features: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = features[key]
        out = tuple(np.full(len(keys), np.nan) for _ in TARGETS)
        for value in dict.fromkeys(keys):
            at = np.array([k == value for k in keys])
            for whole, part in zip(out, predictors[value]({n: v[at] for n, v in features.items() if n != key}), strict=True):
                whole[at] = part
        return out

    return predict


def start_state(history: DataFrame, series_cols: Sequence[str] = (), keep: int = KEEP) -> DataFrame:
    """``(series, last_date, h_purchase, h_redeem)``: the last ``keep`` values of each series, oldest first."""
    latest = F.row_number().over(Window.partitionBy(*series_cols).orderBy(F.desc("date")))
    last = history.withColumn("__k", latest).where(F.col("__k") <= keep)  # all others go before they are shuffled
    rows = F.array_sort(F.collect_list(F.struct("date", *(F.col(t).cast("double").alias(t) for t in TARGETS))))
    listed = last.groupBy(*series_cols).agg(rows.alias("rows"), F.max("date").alias("last_date"))
    return listed.select(*series_cols, "last_date", *(F.col("rows")[t].alias(f"h_{t}") for t in TARGETS))


def _tail(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def _back(a: Column, k: int) -> Column:
    """The k-th last value, or the last where there are fewer."""
    return F.coalesce(F.try_element_at(a, F.lit(-k)), F.try_element_at(a, F.lit(-1)))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _squares(a: Column, mean: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))


def serving_features(ddof: int = 0, targets: Sequence[str] = TARGETS) -> dict[str, Column]:
    """Features of the next day from the arrays ``h_purchase`` and ``h_redeem``, by the names of the training features.

    Short histories give partial windows, and the last value for a lag that is too long; only the same
    day of last month is 0 then. ``ddof`` 0 gives population deviations, 1 those of the training table.
    """
    h = {t: F.col(f"h_{t}") for t in targets}
    out: dict[str, Column] = {}
    for t, a in h.items():
        out |= {f"{t}_lag_{k}": _back(a, k) for k in LAGS}
        for n in WINDOWS:
            w = _tail(a, n)
            mean = _mean(w)
            squares = _squares(w, mean)
            ordered, size = F.array_sort(w), F.size(w)
            middle = (F.get(ordered, F.floor((size - 1) / 2).cast("int")) + F.get(ordered, F.floor(size / 2).cast("int"))) / 2
            out |= {f"{t}_roll_mean_{n}": mean, f"{t}_roll_std_{n}": F.coalesce(F.sqrt(F.try_divide(squares, (size - ddof).cast("double"))), F.lit(0.0)),
                    f"{t}_roll_min_{n}": F.array_min(w), f"{t}_roll_max_{n}": F.array_max(w), f"{t}_roll_median_{n}": middle}
        out[f"{t}_month_start_mean"] = _mean(_tail(a, 30))
        out[f"{t}_same_day_last_month"] = F.coalesce(F.try_element_at(a, F.lit(-30)), F.lit(0.0))
        weeks = [_back(a, 7 * k) for k in (1, 2, 3, 4)]
        out |= {f"{t}_same_weekday_w{k}": w for k, w in zip((1, 2, 3, 4), weeks, strict=True)} | {f"{t}_mean_same_weekday_4w": mean_of_present(weeks)}
    p, r = (lambda k, a=h[t]: _back(a, k) for t in TARGETS)
    return out | {
        "purchase_redeem_ratio_lag1": F.try_divide(p(1), r(1) + 1), "purchase_diff_lag1_hist": p(1) - p(2), "redeem_diff_lag1_hist": r(1) - r(2),
        "purchase_diff_lag7_hist": p(1) - p(8), "redeem_diff_lag7_hist": r(1) - r(8), "net_inflow_lag1": p(1) - r(1), "net_inflow_lag7": p(7) - r(7)}


def boosted_days(date: Column) -> Column:
    """The last three days of a month."""
    return F.dayofmonth(date) >= F.dayofmonth(F.last_day(date)) - 2


def post_process(predicted: Column, recent_mean: Column, low: Column, high: Column, boost: Column, smooth: float = 0.99, floor: float | None = 0.0) -> Column:
    """Smoothing with the recent mean, then the boost factor, then clipping, then the floor."""
    clipped = F.greatest(F.least((predicted * F.lit(smooth) + recent_mean * F.lit(1 - smooth)) * boost, high), low)
    return clipped if floor is None else F.greatest(clipped, F.lit(floor))


def _padded(column: pa.ListArray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``keep`` values of each list, at the right of a row of NaN, and how many they are."""
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    ends, out = np.cumsum(sizes), np.full((len(sizes), keep), np.nan)
    for k in range(1, keep + 1):
        has = sizes >= k
        out[has, -k] = flat[ends[has] - k]
    return out, np.minimum(sizes, keep)


def _served(h: dict[str, np.ndarray], sizes: np.ndarray, ddof: int) -> dict[str, np.ndarray]:
    """``serving_features`` of all series of a batch, from rows of at most ``KEEP`` values and their sizes."""
    def back(t: str, k: int) -> np.ndarray:
        return np.where(sizes >= k, h[t][:, -k], h[t][:, -1])

    out: dict[str, np.ndarray] = {}
    for t, values in h.items():
        out |= {f"{t}_lag_{k}": back(t, k) for k in LAGS}
        for n in WINDOWS:
            w, size = values[:, -n:], np.minimum(sizes, n)
            mean = np.nansum(w, 1) / size
            out[f"{t}_roll_mean_{n}"] = mean
            left = size - ddof
            out[f"{t}_roll_std_{n}"] = np.where(left > 0, np.sqrt(np.nansum((w - mean[:, None]) ** 2, 1) / np.maximum(left, 1)), 0.0)
            out |= {f"{t}_roll_min_{n}": np.nanmin(w, 1), f"{t}_roll_max_{n}": np.nanmax(w, 1), f"{t}_roll_median_{n}": np.nanmedian(w, 1)}
        out[f"{t}_month_start_mean"] = out[f"{t}_roll_mean_30"]
        out[f"{t}_same_day_last_month"] = np.where(sizes >= 30, values[:, -30], 0.0)
        out |= {f"{t}_same_weekday_w{k}": back(t, 7 * k) for k in (1, 2, 3, 4)}
        out[f"{t}_mean_same_weekday_4w"] = sum(out[f"{t}_same_weekday_w{k}"] for k in (1, 2, 3, 4)) / 4
    p, r = (lambda k, t=t: back(t, k) for t in TARGETS)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(r(1) + 1 == 0, np.nan, p(1) / (r(1) + 1))
    return out | {
        "purchase_redeem_ratio_lag1": ratio, "purchase_diff_lag1_hist": p(1) - p(2), "redeem_diff_lag1_hist": r(1) - r(2),
        "purchase_diff_lag7_hist": p(1) - p(8), "redeem_diff_lag7_hist": r(1) - r(8), "net_inflow_lag1": p(1) - r(1), "net_inflow_lag7": p(7) - r(7)}


def recursive_forecast(state: DataFrame, predict: Predictor, horizon: int, series_cols: Sequence[str] = (), holiday_dates: Sequence[str] = cal.HOLIDAYS_2014,
                       boosts: tuple[float, float] = (1.2, 1.3), boost_if: str | None = None, smooth: float = 0.99, floor: float | None = 0.0, ddof: int = 0, batch_series: int = 1024,
                       shown: Sequence[str] = ()) -> DataFrame:
    """``(series, date, purchase_pred, redeem_pred)`` for ``horizon`` days after each series' last.

    ``state``: the columns of ``start_state``, of ``clip_bounds``, and exogenous values by name. Month ends
    are boosted for all series, or for those where the boolean column ``boost_if`` holds. Predictions enter
    the next features clipped and unrounded. The key columns ``shown`` are among what the predictor is given
    (``by_key``). Series do not depend on each other, so there is no step
    between stages: each task takes its series ``batch_series`` at a time through all days.
    """
    day = lambda d: cal.calendar(d) | cal.fourier(d) | cal.month_edges(d) | cal.holidays(d, holiday_dates)
    names = list(day(F.col("date")))
    dates = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.date_add("last_date", i))
    days = F.transform(dates, lambda d: F.struct(d.alias("date"), boosted_days(d).alias("boosted"), *(c.cast("double").alias(n) for n, c in day(d).items())))
    fixed = [f"h_{t}" for t in TARGETS] + [f"{t}_{n}" for t in TARGETS for n in ("lo", "hi")]
    given = [c for c in state.columns if c not in {"last_date", boost_if, *series_cols, *fixed}]
    boosted = F.coalesce(F.col(boost_if), F.lit(False)) if boost_if else F.lit(True)
    ready = state.select(*series_cols, *fixed, boosted.alias("__boosted"), days.alias("__days"), *(F.col(c).cast("double") for c in given))
    schema = StructType([*(state.schema[c] for c in series_cols), StructField("date", DateType()), *(StructField(f"{t}_pred", DoubleType()) for t in TARGETS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch_series):
                batch = whole.slice(lo, batch_series)
                n, column = batch.num_rows, {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                number = lambda c: pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False).astype(float)
                calendar = column["__days"].flatten()
                by_day = {c: number(calendar.field(c)).reshape(n, horizon) for c in names}
                factor = number(calendar.field("boosted")).reshape(n, horizon) * number(column["__boosted"])[:, None]
                values = {c: number(column[c]) for c in given} | {c: np.array(column[c].to_pylist(), object) for c in shown}
                (h, sizes), (other, _) = (_padded(column[f"h_{t}"], KEEP) for t in TARGETS)
                past, made = dict(zip(TARGETS, (h, other), strict=True)), {t: np.empty((n, horizon)) for t in TARGETS}
                for step in range(horizon):
                    raw = predict({c: v[:, step] for c, v in by_day.items()} | _served(past, sizes, ddof) | values)
                    for t, predicted, boost in zip(TARGETS, raw, boosts, strict=True):
                        recent = np.nansum(past[t][:, -7:], 1) / np.minimum(sizes, 7)
                        final = (predicted * smooth + recent * (1 - smooth)) * np.where(factor[:, step] > 0, boost, 1.0)
                        final = np.fmax(np.fmin(final, number(column[f"{t}_hi"])), number(column[f"{t}_lo"]))
                        made[t][:, step] = final if floor is None else np.fmax(final, floor)
                    past = {t: np.concatenate([past[t][:, 1:], made[t][:, step : step + 1]], axis=1) for t in TARGETS}
                    sizes = np.minimum(sizes + 1, KEEP)
                each = pa.array(np.repeat(np.arange(n), horizon))
                out = [*(column[c].take(each) for c in series_cols), calendar.field("date"), *(pa.array(made[t].ravel()) for t in TARGETS)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return ready.mapInArrow(run, schema)


def with_levels(state: DataFrame, *ensembles) -> DataFrame:
    """``state`` with the levels of its series that the ensembles know, for predictors made of them."""
    for e in ensembles:
        state = e.levels.apply(state) if e.levels else state
    return state


def ensemble_predictor(purchase, redeem) -> Predictor:
    """A predictor of two ensembles, by their trees as arrays. The levels of series that they use are in the state (``with_levels``)."""
    trees = [(e.columns, e.flat()) for e in (purchase, redeem)]
    return lambda features: tuple(flat.predict(np.stack([features[c] for c in columns], axis=1)) for columns, flat in trees)


def _joined(state: DataFrame, more: DataFrame, columns: Sequence[str], series_cols: Sequence[str], missing: str) -> DataFrame:
    """``state`` with the ``columns`` of ``more``, which has a row for each series; a series without one is an error when it is used."""
    name = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in series_cols))
    wrong = F.raise_error(F.concat(F.lit(f"{missing}: "), name)).cast("double")
    joined = join_null_safe(state, more.withColumn("__there", F.lit(True)), series_cols)
    return joined.withColumns({c: F.when(F.col("__there").isNull(), wrong).otherwise(F.col(c)) for c in columns}).drop("__there")


def with_exogenous(state: DataFrame, features: DataFrame, columns: Sequence[str], series_cols: Sequence[str] = ()) -> DataFrame:
    """``state`` with the mean of each column over the month of the series' last day; an error where a month has no row.

    Null is a series like any other.
    """
    if not columns:
        return state
    last = state.select(*series_cols, F.trunc("last_date", "MM").alias("__month"))
    rows = features.select(*series_cols, *columns, F.trunc("date", "MM").alias("__month"))
    means = join_null_safe(rows, last, [*series_cols, "__month"], "left_semi").groupBy(*series_cols).agg(F.count(F.lit(1)).alias("__rows"), *(F.avg(c).alias(c) for c in columns))
    if series_cols:
        return _joined(state, means.drop("__rows"), columns, series_cols, "the month before the forecast has no rows")
    got = means.first()
    if not got["__rows"]:
        raise ValueError("the month before the forecast has no rows")
    return state.withColumns({c: F.lit(got[c]).cast("double") for c in columns})


def with_bounds(state: DataFrame, history: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """``state`` with the clip bounds of ``history``; an error where a series has no history. Null is a series like any other."""
    bounds = clip_bounds(history, series_cols)
    if series_cols:
        return _joined(state, bounds, [c for c in bounds.columns if c not in series_cols], series_cols, "there is no history")
    got = bounds.first()
    return state.withColumns({c: F.lit(got[c]).cast("double") for c in bounds.columns})
