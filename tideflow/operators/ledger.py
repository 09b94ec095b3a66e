"""Ledgers: balance checks, daily totals, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.observed import figures

BALANCE_COLUMNS = ("tBalance", "yBalance", "total_purchase_amt", "total_redeem_amt")
REPORT = ("check_item STRING", "status STRING", "message STRING", "total_records BIGINT", "valid_records BIGINT", "consistent_records BIGINT",
          "inconsistent_records BIGINT", "inconsistent_ratio DOUBLE", "max_abs_error DOUBLE", "mean_abs_error DOUBLE")


def balance_quality(ledger: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: how many balances equal yesterday's plus purchases less redemptions, and by how much the rest differ.

    Rows where one of the four amounts is null or not a number do not count as valid. Without valid
    rows the status is ``passed`` and the figures are null; without one of the columns it is ``skipped``.
    """
    missing = [c for c in BALANCE_COLUMNS if c not in ledger.columns]
    names = [r.split()[0] for r in REPORT]
    if missing:
        given = {"check_item": F.lit("balance_consistency"), "status": F.lit("skipped"), "message": F.lit(f"missing columns: {', '.join(missing)}"), "total_records": F.count(F.lit(1))}
        return ledger.agg(*(given.get(n, F.lit(None)).cast(r.split()[1]).alias(n) for n, r in zip(names, REPORT, strict=True)))
    return _quality_report(ledger.select(_imbalance().alias("off")).agg(*_quality_counts(F.col("off"), tolerance)))


def _imbalance() -> Column:
    """By how much a balance is off; null where an amount is none."""
    today, yesterday, bought, redeemed = (F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in BALANCE_COLUMNS)
    return F.abs(today - (yesterday + bought - redeemed))


def _quality_counts(off: Column, tolerance: float) -> list[Column]:
    return [F.count(F.lit(1)).alias("total_records"), F.count(off).alias("valid_records"), F.count_if(off <= tolerance).alias("consistent_records"),
            F.count_if(off > tolerance).alias("inconsistent_records"), F.max(off).alias("max_abs_error"), F.avg(off).alias("mean_abs_error")]


def _quality_report(counted: DataFrame) -> DataFrame:
    return counted.select(
        F.lit("balance_consistency").alias("check_item"), F.when(F.col("inconsistent_records") == 0, "passed").otherwise("warning").alias("status"),
        F.lit("tBalance = yBalance + total_purchase_amt - total_redeem_amt").alias("message"), "total_records", "valid_records", "consistent_records",
        "inconsistent_records", F.try_divide("inconsistent_records", "valid_records").alias("inconsistent_ratio"), "max_abs_error", "mean_abs_error")


def write_daily_with_quality(ledger: DataFrame, path: str, series_cols: Sequence[str] = (), tolerance: float = 1e-6, **flow) -> tuple[DataFrame, DataFrame]:
    """The daily totals, written to ``path``, and the report of ``balance_quality``, both from one pass over the ledger.

    The figures of the report are gathered by the tasks that sum the totals. Options of ``daily_flow`` are taken on. Rows without a date count in
    the report and in no total.
    """
    seen, spark, observed = Observation(), ledger.sparkSession, ledger
    if all(c in ledger.columns for c in BALANCE_COLUMNS):
        observed = ledger.withColumn("__off", _imbalance()).observe(seen, *_quality_counts(F.col("__off"), tolerance)).drop("__off")
    daily = daily_flow(observed, series_cols, **flow)
    daily.write.mode("overwrite").parquet(path)
    got = figures(seen) if observed is not ledger else None
    if got is None:  # columns are missing, or there are no rows: no more than a count
        report = balance_quality(ledger, tolerance)
    else:
        kinds = ", ".join(f"{n} {'DOUBLE' if 'error' in n else 'BIGINT'}" for n in ("total_records", "valid_records", "consistent_records", "inconsistent_records", "max_abs_error", "mean_abs_error"))
        report = _quality_report(spark.createDataFrame([tuple(got[k.split()[0]] for k in kinds.split(", "))], kinds))
    return spark.read.schema(daily.schema).parquet(path), report


def daily_flow(ledger: DataFrame, series_cols: Sequence[str] = (), date: str = "date", purchase: str = "purchase_amt", redeem: str = "redeem_amt", user: str | None = "user_id", approximate_users: bool = False) -> DataFrame:
    """Totals of each day and series, with the number of users and of records.

    Rows without a date are left out. A day whose amounts are all null has the total 0. Without a user
    column the number of users is that of the records. Only days with records appear.
    """
    records = F.count(date).alias("record_count")
    if user is None or user not in ledger.columns:
        users = F.count(date)
    else:
        users = F.approx_count_distinct(user) if approximate_users else F.count_distinct(user)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return ledger.where(F.col(date).isNotNull()).groupBy(*series_cols, F.col(date).alias("date")).agg(
        total(purchase).alias("purchase"), total(redeem).alias("redeem"), users.alias("user_count"), records)


def value_counts(df: DataFrame, column: str, top: int | None = None, unknown: str = "unknown") -> DataFrame:
    """How often each value occurs, nulls as ``unknown``; the most frequent ``top``, ties by value."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), "value").limit(top)


def summary(df: DataFrame, date: str = "date") -> DataFrame:
    """One row: rows, columns, first and last date."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 20, by: Sequence[str] = ("date",)) -> DataFrame:
    return df.orderBy(*by).limit(n)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "target", value: str = "amount") -> DataFrame:
    """Wide to long; the values are cast to double, as they must share a type."""
    return df.select(*ids, *(F.col(v).cast("double") for v in values)).unpivot(list(ids), list(values), name, value)


def join_rates(daily: DataFrame, rates: DataFrame, on: str = "date", check: bool = True) -> DataFrame:
    """``daily`` with the columns of ``rates`` on their date, null on days without.

    Rates are one row a day. With ``check``, a date that comes twice is an error when the rates are used,
    as it would double the day. Spark broadcasts the rates where their size allows it.
    """
    if check:
        names = [c for c in rates.columns if c != on]
        twice = F.raise_error(F.concat(F.lit("two rates on "), F.col(on).cast("string")))
        once = rates.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in names))
        rates = once.select(on, *(F.when(F.col("__n") > 1, twice.cast(rates.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in names))
    return daily.join(rates, on, "left")
