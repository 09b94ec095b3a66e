"""Features of daily series: lags, rolling statistics, calendar, and filled gaps.

All windows are by row, not by calendar day, in the order of the date within a series. With
``series_cols`` empty there is one series; the frames then run in one partition, over one row a day.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import calendar as cal
from ..functions.joins import join_null_safe

TARGETS = ("purchase", "redeem")
LAGS = (1, 2, 3, 7, 14, 30)
WINDOWS = (3, 7, 14, 30)


def in_series(series_cols: Sequence[str] = (), date: str = "date") -> WindowSpec:
    return Window.partitionBy(*series_cols).orderBy(date)


def _past(series_cols: Sequence[str], rows: int) -> WindowSpec:
    return in_series(series_cols).rowsBetween(-rows, -1)


def _full(value: Column, target: str, frame: WindowSpec, rows: int) -> Column:
    """``value`` where the frame is full and holds no null."""
    return F.when(F.count(target).over(frame) == rows, value)


def lags(series_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS, steps: Sequence[int] = LAGS) -> dict[str, Column]:
    w = in_series(series_cols)
    return {f"{t}_lag_{k}": F.lag(t, k).over(w) for t in targets for k in steps}


def rolling(series_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS, windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    """Mean, sample deviation, least and greatest of the previous rows; null for a window that is not full."""
    out = {}
    for t in targets:
        for n in windows:
            frame = _past(series_cols, n)
            for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                out[f"{t}_roll_{name}_{n}"] = _full(agg(t).over(frame), t, frame, n)
    return out


def rolling_median(series_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS, windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    return {f"{t}_roll_median_{n}": _full(F.percentile(t, F.lit(0.5)).over(_past(series_cols, n)), t, _past(series_cols, n), n) for t in targets for n in windows}


def month_start_mean(series_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS) -> dict[str, Column]:
    """The mean of the previous 30 rows, under the name by which models know it."""
    return {f"{t}_month_start_mean": _full(F.avg(t).over(_past(series_cols, 30)), t, _past(series_cols, 30), 30) for t in targets}


def mean_of_present(columns: Sequence[Column]) -> Column:
    """The mean of those that are not null."""
    total = reduce(add, (F.coalesce(c, F.lit(0)) for c in columns)).cast("double")
    return F.try_divide(total, reduce(add, (c.isNotNull().cast("int") for c in columns)))


def same_period(series_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS) -> dict[str, Column]:
    """The value 30 rows ago, those of the last four weekdays alike, and the mean of those four."""
    w, out = in_series(series_cols), {}
    for t in targets:
        weeks = {f"{t}_same_weekday_w{k}": F.lag(t, 7 * k).over(w) for k in (1, 2, 3, 4)}
        out |= {f"{t}_same_day_last_month": F.lag(t, 30).over(w)} | weeks | {f"{t}_mean_same_weekday_4w": mean_of_present([*weeks.values()])}
    return out


def ratio_diff(series_cols: Sequence[str] = (), purchase: str = "purchase", redeem: str = "redeem") -> dict[str, Column]:
    w = in_series(series_cols)
    p, r = (lambda k, t=t: F.lag(t, k).over(w) for t in (purchase, redeem))
    return {
        "purchase_redeem_ratio_lag1": F.try_divide(p(1), r(1) + 1),
        "purchase_diff_lag1_hist": p(1) - p(2),
        "redeem_diff_lag1_hist": r(1) - r(2),
        "purchase_diff_lag7_hist": p(1) - p(8),
        "redeem_diff_lag7_hist": r(1) - r(8),
        "net_inflow_lag1": p(1) - r(1),
        "net_inflow_lag7": p(7) - r(7),
    }


#: Features that are the same under two names.
_SAME = {"month_start_mean": "roll_mean_30", "same_weekday_w1": "lag_7", "same_weekday_w2": "lag_14", "same_day_last_month": "lag_30"}


def window_features(series_cols: Sequence[str] = ()) -> dict[str, Column]:
    """All features that look back in a series, by name."""
    return lags(series_cols) | rolling(series_cols) | rolling_median(series_cols) | month_start_mean(series_cols) | same_period(series_cols) | ratio_diff(series_cols)


def own_and_named(windows: dict[str, Column]) -> tuple[dict[str, Column], dict[str, str]]:
    """The window features that are to be computed, and the names by which some of them go, too."""
    again = {f"{t}_{a}": f"{t}_{b}" for t in TARGETS for a, b in _SAME.items()}
    return {n: c for n, c in windows.items() if n not in again}, again


def calendar_features(holiday_dates: Sequence[str] = cal.HOLIDAYS_2014, date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    return cal.calendar(d) | cal.fourier(d) | cal.month_edges(d) | cal.holidays(d, holiday_dates)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def fill_missing(df: DataFrame, series_cols: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls of numeric columns get the last value before, else the first after, else 0, within the series."""
    names = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in series_cols]
    w = in_series(series_cols)
    # Only the head of a series has nothing before it, and there the first value after is the first of all:
    # a frame of the whole series is aggregated once, one from each row to the end would be at every row.
    before, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(whole), F.lit(0).cast(df.schema[c].dataType)) for c in names})


#: What a day without records has none of; all else of it is unknown.
COUNTED = (*TARGETS, "user_count", "record_count")


def fill_calendar(daily: DataFrame, series_cols: Sequence[str] = (), counted: Sequence[str] = COUNTED) -> DataFrame:
    """``daily`` with a row for every day between a series' first and last; the added ones have 0 in the ``counted`` columns and null in all others."""
    spans = daily.groupBy(*series_cols).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = spans.where("a IS NOT NULL").select(*series_cols, F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date"))
    joined = join_null_safe(days, daily.withColumn("__there", F.lit(True)), [*series_cols, "date"])
    return joined.withColumns({c: F.when(F.col("__there").isNull(), F.lit(0).cast(daily.schema[c].dataType)).otherwise(F.col(c)) for c in counted if c in daily.columns}).drop("__there")


def add_features(daily: DataFrame, series_cols: Sequence[str] = (), holiday_dates: Sequence[str] = cal.HOLIDAYS_2014, calendar_gaps: str = "rows", carried: DataFrame | None = None) -> DataFrame:
    """The whole feature table of daily totals (and rates), gaps filled.

    ``carried`` are filled rows of such a table, one a series, whose values stand for those of their days: filling goes on from them.
    ``calendar_gaps``: ``rows`` shifts over the rows that are there, ``fill`` adds the missing days first.
    """
    if calendar_gaps not in ("rows", "fill"):
        raise ValueError("calendar_gaps is rows or fill")
    df = fill_calendar(daily, series_cols) if calendar_gaps == "fill" else daily
    windows = window_features(series_cols)
    # What goes by two names is taken once, and only what can be null is filled: nothing of the calendar.
    own, again = own_and_named(windows)
    numbers = [c for c in numeric_columns(df) if c not in series_cols]
    made = df.withColumns(own)
    if carried is not None:
        known = carried.select(*series_cols, "date", *(F.col(again.get(c, c)).cast(made.schema[c].dataType).alias(f"__known_{c}") for c in [*numbers, *own]))
        made = join_null_safe(made, known, [*series_cols, "date"])
        made = made.withColumns({c: F.coalesce(f"__known_{c}", c) for c in [*numbers, *own]}).drop(*(f"__known_{c}" for c in [*numbers, *own]))
    filled = fill_missing(made, series_cols, [*numbers, *own])
    calendar = calendar_features(holiday_dates)
    return filled.select(*df.columns, *(of_kind(c, n, CALENDAR) for n, c in calendar.items()), *(of_kind(F.col(again.get(n, n)), n, kind_of(n)) for n in windows))


#: Kinds of features, kept as metadata of their columns under the name ``kind``: Parquet and renaming keep it.
CALENDAR, PAST, MONTH_MEAN = "calendar", "past", "month mean"


def of_kind(column: Column, name: str, kind: str) -> Column:
    """``column`` as ``name``, a feature that a forecast knows by the ``kind`` of its column."""
    return column.alias(name, metadata={"kind": kind})


def kind_of(name: str) -> str:
    """The kind of a feature of ``window_features``."""
    return MONTH_MEAN if name in {f"{t}_month_start_mean" for t in TARGETS} else PAST


def model_columns(features: DataFrame, series_cols: Sequence[str] = (), same_day_counts: bool = False) -> list[str]:
    """Numeric columns a model may see: not the targets and keys, and not the counts of the day itself unless asked for."""
    counts = () if same_day_counts else ("user_count", "record_count")
    return numeric_columns(features, {*TARGETS, "date", *series_cols, *counts})


def exogenous_columns(columns: Sequence[str], freeze_month_mean: bool = False, of: DataFrame | None = None) -> list[str]:
    """Those that neither the calendar nor the targets' past gives, so that a forecast must carry them forward.

    A column of the table ``of`` is classed by the kind that it carries (``of_kind``), whatever its name; one without a kind by its name.
    ``freeze_month_mean`` counts the 30-row means among them, which holds them at last month's mean.
    """
    kinds = {f.name: f.metadata.get("kind") for f in of.schema} if of is not None else {}
    by_name = dict.fromkeys(calendar_features(), CALENDAR) | {n: kind_of(n) for n in window_features()}
    known = {CALENDAR, PAST} if freeze_month_mean else {CALENDAR, PAST, MONTH_MEAN}
    return [c for c in columns if (kinds.get(c) or by_name.get(c)) not in known and c not in ("date", *TARGETS)]


def previous_month_means(features: DataFrame, columns: Sequence[str], series_cols: Sequence[str] = ()) -> DataFrame:
    """``(series, month, columns)``: the mean of each column over the month before ``month``."""
    month = F.add_months(F.trunc("date", "MM"), 1).alias("month")
    return features.groupBy(*series_cols, month).agg(*(F.avg(c).alias(c) for c in columns))


def clip_bounds(history: DataFrame, series_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS, shares: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Exact percentiles of each target by series, interpolated between values: ``{t}_lo`` and ``{t}_hi``."""
    both = history.groupBy(*series_cols).agg(*(F.percentile(t, F.array(*map(F.lit, shares))).alias(t) for t in targets))
    return both.select(*series_cols, *(F.col(t)[i].alias(f"{t}_{n}") for t in targets for i, n in enumerate(("lo", "hi"))))
