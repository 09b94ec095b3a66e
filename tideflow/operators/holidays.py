"""Holidays by region: the nearest holiday before and after each day, from a calendar that is a table.

An as-of join in both directions. The days of a region and its holidays are merged in one sort by region and
date; the last holiday so far is carried forward over the days, and backward from the other end. Only the
different days of a region take part, of which there are a few thousand a region however many rows they have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import flag
from ..functions.joins import join_null_safe


def nearest_holidays(days: DataFrame, calendar: DataFrame, region_cols: Sequence[str] = (), date: str = "date", calendar_date: str = "date") -> DataFrame:
    """``(regions, date, last_holiday, next_holiday)`` of each different day: the holidays of its region at or before it, and at or after it.

    Null where there is none. A null region is one like any other; rows of the calendar without a date are none.
    """
    keys = list(region_cols)
    wanted = days.where(F.col(date).isNotNull()).select(*keys, F.col(date).alias("__day"), F.lit(None).cast("date").alias("__holiday")).distinct()
    holidays = calendar.where(F.col(calendar_date).isNotNull()).select(*keys, F.col(calendar_date).cast("date").alias("__day"), F.col(calendar_date).cast("date").alias("__holiday")).distinct()
    merged = wanted.unionByName(holidays)
    # Of one date the holiday comes first in either direction, so that a holiday is its own nearest.
    holiday_first = F.col("__holiday").isNull()
    forward = Window.partitionBy(*keys).orderBy("__day", holiday_first).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys).orderBy(F.desc("__day"), holiday_first).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumns({"last_holiday": F.last("__holiday", True).over(forward), "next_holiday": F.last("__holiday", True).over(backward)})
    return found.where(F.col("__holiday").isNull()).select(*keys, F.col("__day").alias(date), "last_holiday", "next_holiday")


def regional_holidays(days: DataFrame, calendar: DataFrame, region_cols: Sequence[str] = (), date: str = "date", calendar_date: str = "date", fallback: int = 30) -> DataFrame:
    """``days`` with the holiday features of ``functions.calendar.holidays``, by the calendar of each row's region.

    A region without holidays on a side has the ``fallback`` distance there. All rows and columns of ``days`` stay; a row without a date
    has nulls.
    """
    near = nearest_holidays(days, calendar, region_cols, date, calendar_date)
    joined = join_null_safe(days, near, [*region_cols, date])
    day = F.col(date)
    known = lambda c: F.when(day.isNotNull(), c)
    ahead, behind = F.coalesce(F.datediff("next_holiday", day), F.lit(fallback)), F.coalesce(F.datediff(day, F.col("last_holiday")), F.lit(fallback))
    return joined.withColumns({
        "is_holiday": known(flag(F.coalesce(F.col("next_holiday") == day, F.lit(False)))),
        "days_to_next_holiday": known(ahead),
        "days_from_last_holiday": known(behind),
        "is_day_before_holiday": known(flag(ahead == 1)),
        "is_day_after_holiday": known(flag(behind == 1)),
    }).drop("last_holiday", "next_holiday")
