"""Features of series that are too long for one task.

A window over a series runs in one task. Here rows are numbered in the order of series and date, by ranges that are sorted
apart, and cut into chunks of equal numbers of rows. A chunk also gets the last rows before it, as many as the windows
reach back to; its frames are then those of the whole series. Filling carries the last value of each chunk
to the next ones over a table of chunks, and goes on from it inside of each.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.joins import join_null_safe
from ..functions.lineage import cut_lineage
from .features import CALENDAR, LAGS, WINDOWS, calendar_features, kind_of, numeric_columns, of_kind, own_and_named, window_features

#: The most rows that a frame or a lag of the features reaches back.
REACH = max(*LAGS, *WINDOWS, 30)
CHUNK_ROWS = 20_000


def numbered(rows: DataFrame, series_cols: Sequence[str] = (), date: str = "date") -> DataFrame:
    """``rows``, written once, with ``__at``: their numbers from 0 in the order of series (null first) and date.

    The driver adds up one count for each range.
    """
    order = [F.asc_nulls_first(c) for c in (*series_cols, date)]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    told = cut_lineage(ranged.withColumn("__nth", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__nth", 33), F.col("__nth").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(told.groupBy(part.alias("part")).count().collect())  # a row for each range
    before = dict(zip((r.part for r in sizes), accumulate((r["count"] for r in sizes), initial=0), strict=False))
    offsets = F.create_map(*(F.lit(x).cast("bigint") for pair in before.items() for x in pair)) if before else F.lit(None)
    return told.withColumn("__at", (F.element_at(offsets, part) if before else F.lit(0).cast("bigint")) + inside).drop("__nth")


def in_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, reach: int = REACH) -> DataFrame:
    """``numbered`` rows with their ``__chunk``, and the ``reach`` rows before each chunk once more under it, marked ``__halo``."""
    if chunk_rows < reach:
        raise ValueError(f"a chunk has {reach} rows at least")
    own = F.floor(F.col("__at") / chunk_rows)
    twice = F.col("__at") % chunk_rows >= chunk_rows - reach
    copies = F.when(twice, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo")))).otherwise(
        F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo"))))
    return rows.withColumn("__c", F.explode(copies)).withColumns({"__chunk": F.col("__c.chunk"), "__halo": F.col("__c.halo")}).drop("__c")


def fill_in_chunks(rows: DataFrame, columns: Sequence[str], series_cols: Sequence[str] = (), date: str = "date") -> DataFrame:
    """As ``fill_missing``, for rows with ``__at`` and ``__chunk``: nulls get the last value before in their series, else the first after, else 0."""
    keys, one = list(series_cols), "__one"
    spot = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct("__at", F.col(c).alias("v")))).alias(c)
    ends = rows.groupBy(*keys, "__chunk").agg(*(spot(c, F.max) for c in columns), F.struct(*(spot(c, F.min) for c in columns)).alias("__firsts"))
    # A row for each series and chunk from here on.
    ends = cut_lineage(ends.withColumn(one, F.lit(0)))
    by = Window.partitionBy(*(keys or [one]))
    past = by.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(*keys, "__chunk", *(x for c in columns for x in (F.max(c).over(past)["v"].alias(f"__before_{c}"), F.min(F.col("__firsts")[c]).over(whole)["v"].alias(f"__first_{c}"))))
    inside = Window.partitionBy("__chunk", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(rows, carried, [*keys, "__chunk"])
    filled = joined.withColumns({c: F.coalesce(F.last(c, True).over(inside), f"__before_{c}", f"__first_{c}", F.lit(0).cast(rows.schema[c].dataType)) for c in columns})
    return filled.drop(*(f"__{k}_{c}" for c in columns for k in ("before", "first")))


def add_features_in_chunks(daily: DataFrame, series_cols: Sequence[str] = (), holiday_dates: Sequence[str] = cal.HOLIDAYS_2014, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The table of ``features.add_features`` (of the rows that are there), with no task that has a whole series unless it is short.

    Days of one series that come twice are in the order in which they were numbered.
    """
    windows = window_features(["__chunk", *series_cols])
    own, again = own_and_named(windows)
    numbers = [c for c in numeric_columns(daily) if c not in series_cols]
    chunks = in_chunks(numbered(daily, series_cols), chunk_rows)
    made = chunks.withColumns(own).where("NOT __halo")
    filled = fill_in_chunks(made, [*numbers, *own], series_cols)
    return filled.select(*(F.col(f"`{c}`") for c in daily.columns), *(of_kind(c, n, CALENDAR) for n, c in calendar_features(holiday_dates).items()), *(of_kind(F.col(again.get(n, n)), n, kind_of(n)) for n in windows))
