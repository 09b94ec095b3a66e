"""Writing features, reports, forecasts and submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features import LAGS, WINDOWS, add_features


def write_features(features: DataFrame, path: str) -> None:
    """Parquet by month, so that a range of dates reads its months alone."""
    features.withColumn("month_key", F.date_format("date", "yyyy-MM")).write.partitionBy("month_key").mode("overwrite").parquet(path)


def update_features(path: str, daily: DataFrame, since: str, series_cols: Sequence[str] = (), **options) -> list[str]:
    """Bring the feature table of ``write_features`` up to ``daily`` from the month of ``since`` (a date) on; returns the months written.

    ``daily`` holds the daily totals and rates of all days, of which the months from then on and, before them, the last
    rows of each series that windows reach back to are read. Only those months' partitions are replaced, by an atomic commit
    for each; the rest of the table is left as it is. What is filled forward starts from the stored values of each series' last day before. The months equal those of
    a table built anew, where the targets have no nulls and a series' columns a first value before the month. Options are those of ``add_features``.
    """
    spark, first = daily.sparkSession, F.trunc(F.lit(since).cast("date"), "MM")
    after, before = daily.where(F.col("date") >= first), daily.where(F.col("date") < first)
    months = [r[0] for r in after.select(F.date_format("date", "yyyy-MM")).distinct().orderBy(F.date_format("date", "yyyy-MM")).collect()]  # a row a month
    newest = F.row_number().over(Window.partitionBy(*series_cols).orderBy(F.desc("date")))
    reach = max(*LAGS, *WINDOWS, 30) + 1
    tail = before.withColumn("__k", newest).where(F.col("__k") <= reach).drop("__k")
    stored = spark.read.parquet(path).where((F.col("date") < first) & (F.col("month_key") < F.date_format(first, "yyyy-MM"))).drop("month_key")
    carried = stored.withColumn("__k", newest).where("__k = 1").drop("__k")
    made = add_features(tail.unionByName(after), series_cols, carried=carried, **options).where(F.col("date") >= first)
    made.withColumn("month_key", F.date_format("date", "yyyy-MM")).write.partitionBy("month_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return months


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def write_folds(predictions: DataFrame, path: str) -> None:
    predictions.write.partitionBy("fold").mode("overwrite").parquet(path)


def submission(forecast: DataFrame, series_cols: Sequence[str] = (), purchase: str = "purchase_pred", redeem: str = "redeem_pred") -> DataFrame:
    """``report_date`` as the number yyyyMMdd, and both amounts rounded half to even."""
    return forecast.select(*series_cols, F.date_format("date", "yyyyMMdd").cast("int").alias("report_date"),
                           F.bround(purchase).cast("bigint").alias("purchase"), F.bround(redeem).cast("bigint").alias("redeem"))


def write_submission(forecast: DataFrame, path: str, series_cols: Sequence[str] = ()) -> None:
    """The submission twice: under ``plain`` without a header, under ``headed`` with one."""
    rows = submission(forecast, series_cols)
    write_csv(rows, f"{path}/plain", header=False)
    write_csv(rows, f"{path}/headed", header=True)
