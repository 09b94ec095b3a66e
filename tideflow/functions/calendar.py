"""Calendar features of a date column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default holiday calendar.
HOLIDAYS_2014 = (
    "2014-01-01", "2014-01-31", "2014-02-01", "2014-02-02", "2014-02-03", "2014-02-04", "2014-02-05", "2014-02-06",
    "2014-04-05", "2014-04-06", "2014-04-07",
    "2014-05-01", "2014-05-02", "2014-05-03",
    "2014-05-31", "2014-06-01", "2014-06-02",
    "2014-09-06", "2014-09-07", "2014-09-08",
    "2014-10-01", "2014-10-02", "2014-10-03", "2014-10-04", "2014-10-05", "2014-10-06", "2014-10-07",
)


def parse_report_date(c: Column) -> Column:
    """yyyyMMdd as a date; null where it is not one."""
    return F.try_to_date(c.cast("string"), "yyyyMMdd")


def flag(condition: Column) -> Column:
    return condition.cast("int")


def calendar(date: Column) -> dict[str, Column]:
    """Day of week (Monday 0), day, month, and flags of weekend, first and last day of the month."""
    return {
        "dayofweek": F.weekday(date),
        "dayofmonth": F.dayofmonth(date),
        "month": F.month(date),
        "is_weekend": flag(F.weekday(date) >= 5),
        "is_month_start": flag(F.dayofmonth(date) == 1),
        "is_month_end": flag(date == F.last_day(date)),
    }


def fourier(date: Column) -> dict[str, Column]:
    """Sine and cosine of the day of the week, the day of the month and the month."""
    out = {}
    for name, value, period in (("dayofweek", F.weekday(date), 7), ("dayofmonth", F.dayofmonth(date), 31), ("month", F.month(date), 12)):
        angle = F.lit(2 * math.pi) * value / F.lit(period)
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return out


def month_edges(date: Column) -> dict[str, Column]:
    """Distances to the month's edges, flags of its first and last 3 and 7 days, and decaying weights."""
    start = F.dayofmonth(date) - 1
    end = F.dayofmonth(F.last_day(date)) - F.dayofmonth(date)
    return {
        "days_to_month_start": start,
        "days_to_month_end": end,
        "is_first_3_days": flag(start < 3),
        "is_last_3_days": flag(end < 3),
        "is_first_7_days": flag(start < 7),
        "is_last_7_days": flag(end < 7),
        "month_start_weight": F.exp(-start / F.lit(3.0)),
        "month_end_weight": F.exp(-end / F.lit(3.0)),
    }


def holidays(date: Column, calendar_dates: Sequence[str] = HOLIDAYS_2014, fallback: int = 30) -> dict[str, Column]:
    """Holiday flag, days to the next and since the last (``fallback`` where there is none), and flags of the days around.

    The calendar is a sorted literal of the plan, so the search needs no join.
    """
    days = F.array(*(F.lit(d).cast("date") for d in sorted(set(calendar_dates)))) if calendar_dates else F.array().cast("array<date>")
    following = F.try_element_at(F.filter(days, lambda h: h >= date), F.lit(1))
    previous = F.try_element_at(F.filter(days, lambda h: h <= date), F.lit(-1))
    ahead = F.coalesce(F.datediff(following, date), F.lit(fallback))
    behind = F.coalesce(F.datediff(date, previous), F.lit(fallback))
    return {
        "is_holiday": flag(F.array_contains(days, date)),
        "days_to_next_holiday": ahead,
        "days_from_last_holiday": behind,
        "is_day_before_holiday": flag(ahead == 1),
        "is_day_after_holiday": flag(behind == 1),
    }


def anomaly_class(date: Column, isolated: str = "08-08") -> Column:
    """The first that holds: first day of the month, last three, Sunday, the isolated day, last five, or normal."""
    left = F.dayofmonth(F.last_day(date)) - F.dayofmonth(date)
    return (F.when(F.dayofmonth(date) == 1, "month_start").when(left <= 2, "month_end").when(F.weekday(date) == 6, "sunday")
            .when(F.date_format(date, "MM-dd") == isolated, "isolated_high").when(left <= 4, "near_month_end").otherwise("normal"))
