"""The tables that the registered queries start from, derived from the given ones.

``SQL`` states each view for the oracle; the functions build the same with the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import fill_missing, in_series
from ..operators.ledger import daily_flow, join_rates

#: 1 January, 1 May and 1 to 3 October, from 1995-05-01 to 2001-05-01.
HOLIDAYS = sorted(d for y in range(1995, 2002) for d in (f"{y}-01-01", f"{y}-05-01", f"{y}-10-01", f"{y}-10-02", f"{y}-10-03") if "1995-05-01" <= d <= "2001-05-01")

SQL = {
    "txn": """SELECT CAST(l.l_shipdate AS DATE) AS date, o.o_custkey AS user_id, c.c_mktsegment AS segment,
       CASE WHEN l.l_returnflag <> 'R' THEN CAST(round(l.l_extendedprice * 100) AS BIGINT) ELSE 0 END AS purchase_amt,
       CASE WHEN l.l_returnflag = 'R' THEN CAST(round(l.l_extendedprice * 100) AS BIGINT) ELSE 0 END AS redeem_amt
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "daily": """SELECT date, CAST(coalesce(sum(purchase_amt), 0) AS BIGINT) AS purchase, CAST(coalesce(sum(redeem_amt), 0) AS BIGINT) AS redeem,
       count(DISTINCT user_id) AS user_count, count(date) AS record_count FROM txn GROUP BY date""",
    "daily_panel": """SELECT segment, date, CAST(coalesce(sum(purchase_amt), 0) AS BIGINT) AS purchase, CAST(coalesce(sum(redeem_amt), 0) AS BIGINT) AS redeem,
       count(DISTINCT user_id) AS user_count, count(date) AS record_count FROM txn GROUP BY segment, date""",
    "daily_yield": """SELECT CAST(o_orderdate AS DATE) AS date, avg(CAST(round(o_totalprice * 100) AS BIGINT)) / 1000000 AS mfd_daily_yield,
       CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1000000 AS mfd_7daily_yield FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "interbank": """SELECT CAST(o_orderdate AS DATE) AS date, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS Interest_1,
       avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS Interest_2, avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS Interest_3
FROM orders WHERE extract(DAY FROM CAST(o_orderdate AS DATE)) % 7 NOT IN (0, 6) GROUP BY CAST(o_orderdate AS DATE)""",
    "balances": """SELECT event_id, CAST(ts AS DATE) AS date, user_id,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE run + CASE WHEN event_id % 97 = 0 THEN 100 ELSE 0 END END AS tBalance,
       run - pur + red AS yBalance, pur AS total_purchase_amt, red AS total_redeem_amt
FROM (SELECT *, CAST(sum(pur - red) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run
      FROM (SELECT event_id, ts, user_id, CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS pur,
                   CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS red FROM events) e) r""",
    "profile": """SELECT c_custkey AS user_id, nullif(c_mktsegment, 'FURNITURE') AS sex, CAST(c_nationkey AS VARCHAR(10)) AS city, substr(c_name, length(c_name), 1) AS constellation FROM customer""",
    "forecast": """SELECT date, purchase_true, purchase_pred, redeem_true, redeem_pred
FROM (SELECT date, purchase AS purchase_true, lag(purchase, 7) OVER (ORDER BY date) AS purchase_pred, redeem AS redeem_true, lag(redeem, 7) OVER (ORDER BY date) AS redeem_pred FROM daily) x
WHERE purchase_pred IS NOT NULL""",
    "rated": """SELECT d.*, y.mfd_daily_yield, y.mfd_7daily_yield, i.Interest_1, i.Interest_2, i.Interest_3
FROM daily d LEFT JOIN daily_yield y ON d.date = y.date LEFT JOIN interbank i ON d.date = i.date""",
}
_NEEDS = {"daily": ["txn"], "daily_panel": ["txn"], "forecast": ["txn", "daily"], "rated": ["txn", "daily", "daily_yield", "interbank"]}


def with_views(*names: str) -> str:
    """The WITH clause that defines the views and those they need."""
    wanted = list(dict.fromkeys(v for n in names for v in [*_NEEDS.get(n, []), n]))
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in wanted) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("bigint")


def txn(spark: SparkSession, sf_dir: str, segments: bool = False) -> DataFrame:
    """Line items as ledger rows; the customers are joined only where their segment is asked for, and to the orders, so that line items are shuffled once."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if segments:
        orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    returned = F.col("l_returnflag") == "R"
    return rows.select(F.col("l_shipdate").cast("date").alias("date"), F.col("o_custkey").alias("user_id"), *([F.col("c_mktsegment").alias("segment")] if segments else []),
                       F.when(~returned, _cents("l_extendedprice")).otherwise(0).alias("purchase_amt"), F.when(returned, _cents("l_extendedprice")).otherwise(0).alias("redeem_amt"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_flow(txn(spark, sf_dir))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_flow(txn(spark, sf_dir, segments=True), ["segment"])


def daily_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _cents("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.avg(cents) / 1000000).alias("mfd_daily_yield"), (F.max(cents).cast("double") / 1000000).alias("mfd_7daily_yield"))


def interbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenors = {"Interest_1": "1-URGENT", "Interest_2": "2-HIGH", "Interest_3": "3-MEDIUM"}
    orders = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    return orders.where(~(F.dayofmonth("date") % 7).isin(0, 6)).groupBy("date").agg(
        *(F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(n) for n, p in tenors.items()))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _cents("value")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(F.col("event_type") == "purchase", cents).otherwise(0).alias("pur"),
                                                 F.when(F.col("event_type") == "error", cents).otherwise(0).alias("red"))
    run = F.sum(F.col("pur") - F.col("red")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    today = F.when(F.col("event_id") % 101 != 0, F.col("run") + F.when(F.col("event_id") % 97 == 0, 100).otherwise(0))
    return rows.select("event_id", F.col("ts").cast("date").alias("date"), "user_id", today.alias("tBalance"), (F.col("run") - F.col("pur") + F.col("red")).alias("yBalance"),
                       F.col("pur").alias("total_purchase_amt"), F.col("red").alias("total_redeem_amt"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("sex"),
                                                   F.col("c_nationkey").cast("string").alias("city"), F.substr(name, F.length(name), F.lit(1)).alias("constellation"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of seven rows before as the prediction."""
    w = in_series()
    rows = daily(spark, sf_dir).select("date", F.col("purchase").alias("purchase_true"), F.lag("purchase", 7).over(w).alias("purchase_pred"),
                                       F.col("redeem").alias("redeem_true"), F.lag("redeem", 7).over(w).alias("redeem_pred"))
    return rows.where("purchase_pred IS NOT NULL")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join_rates(daily(spark, sf_dir), daily_yield(spark, sf_dir), check=False)  # grouped by date: one row each
    return join_rates(out, interbank(spark, sf_dir), check=False)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_missing(rated(spark, sf_dir))
