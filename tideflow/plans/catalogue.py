"""Registered queries of the engine's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scores
from ..functions.lineage import cut_lineage, new_path, scratch
from ..functions.parallel import side_by_side
from ..operators import backtest, evaluate, features, forecast, holidays, ledger, long_series, models, selection
from ..sources import checked
from ..sources.sinks import submission, update_features, write_features
from . import views
from .views import HOLIDAYS, with_views

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
T = features.TARGETS


def _register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return add


def _settled(query: Query) -> Query:
    """``query`` with its result written, and what it wrote on its way deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            return cut_lineage(query(spark, sf_dir), keep=True)

    return run


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _rounded(columns: dict[str, Column], digits: int, only: tuple[str, ...] = ()) -> list[Column]:
    return [(F.round(c.cast("double"), digits) if not only or any(o in n for o in only) else c).alias(n) for n, c in columns.items()]


# Ledgers

@_register(with_views("balances") + """, v AS (SELECT abs(tBalance - (yBalance + total_purchase_amt - total_redeem_amt)) AS off FROM balances)
SELECT 'balance_consistency' AS check_item, CASE WHEN count(*) FILTER (WHERE off > 0) = 0 THEN 'passed' ELSE 'warning' END AS status,
       'tBalance = yBalance + total_purchase_amt - total_redeem_amt' AS message, count(*) AS total_records, count(off) AS valid_records,
       count(*) FILTER (WHERE off = 0) AS consistent_records, count(*) FILTER (WHERE off > 0) AS inconsistent_records,
       round(count(*) FILTER (WHERE off > 0) / count(off), 9) AS inconsistent_ratio, CAST(max(off) AS DOUBLE) AS max_abs_error, round(avg(off), 9) AS mean_abs_error FROM v""")
def balance_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.balance_quality(views.balances(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("inconsistent_ratio", "mean_abs_error")})


@_register(with_views("balances") + """, v AS (SELECT abs(tBalance - (yBalance + total_purchase_amt - total_redeem_amt)) AS off FROM balances)
SELECT 'balance_consistency' AS check_item, CASE WHEN count(*) FILTER (WHERE off > 0) = 0 THEN 'passed' ELSE 'warning' END AS status,
       'tBalance = yBalance + total_purchase_amt - total_redeem_amt' AS message, count(*) AS total_records, count(off) AS valid_records,
       count(*) FILTER (WHERE off = 0) AS consistent_records, count(*) FILTER (WHERE off > 0) AS inconsistent_records,
       round(count(*) FILTER (WHERE off > 0) / count(off), 9) AS inconsistent_ratio, CAST(max(off) AS DOUBLE) AS max_abs_error, round(avg(off), 9) AS mean_abs_error FROM v""")
def balance_quality_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of ``balance_quality_report``, gathered while the daily totals are written."""
    with scratch(spark):  # the report is one row by then
        _, found = ledger.write_daily_with_quality(views.balances(spark, sf_dir), new_path(spark), purchase="total_purchase_amt", redeem="total_redeem_amt")
    return found.withColumns({c: F.round(c, 9) for c in ("inconsistent_ratio", "mean_abs_error")})


#: Lines of events: every 50th without its last field, every 70th with one more, every 30th with a date that is none, every 90th with an amount that is none.
_LINES = ("event_id % 50 = 0", "event_id % 70 = 0", "event_id % 30 = 0", "event_id % 90 = 0")


@_register(f"""SELECT CASE WHEN {_LINES[0]} OR {_LINES[1]} THEN 'fields' WHEN {_LINES[2]} OR {_LINES[3]} THEN 'value' ELSE 'none' END AS reason,
CASE WHEN {_LINES[0]} OR {_LINES[1]} THEN '' ELSE concat_ws(',', CASE WHEN {_LINES[2]} THEN 'report_date' END, CASE WHEN {_LINES[3]} THEN 'amount' END) END AS columns, count(*) AS n FROM events GROUP BY ALL""")
@_settled
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV file by why they are no rows, ``none`` for those that are."""
    short, long, undated, unpriced = map(F.expr, _LINES)
    line = F.concat_ws(",", F.when(undated, "20131301").otherwise(F.date_format("ts", "yyyyMMdd")), F.col("user_id").cast("string"), F.when(unpriced, "much").otherwise(F.col("value").cast("string")),
                       F.when(long, F.concat("event_type", F.lit(",more"))).when(~short, F.col("event_type")))
    lines = views.table(spark, sf_dir, "events").select(F.when(long & short, F.lit("one field")).otherwise(line).alias("value"))
    source, into = new_path(spark), new_path(spark)
    lines.write.text(source)
    found = checked.read_checked(spark, source, "report_date DATE, user_id BIGINT, amount DOUBLE, event_type STRING", into, header=("report_date", "user_id", "amount", "event_type"))
    rejected = found.rejected.select("reason", F.array_join("columns", ",").alias("columns"))
    return rejected.unionByName(found.rows.select(F.lit("none").alias("reason"), F.lit("").alias("columns"))).groupBy("reason", "columns").agg(F.count(F.lit(1)).alias("n"))


@_register("""SELECT date, count(*) AS n_rows FROM (SELECT CAST(try_strptime(CASE WHEN event_id % 50 = 0 THEN '20131301' ELSE strftime(ts, '%Y%m%d') END, '%Y%m%d') AS DATE) AS date FROM events)
WHERE date IS NOT NULL GROUP BY date""")
def parse_report_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("event_id") % 50 == 0, "20131301").otherwise(F.date_format("ts", "yyyyMMdd"))
    dated = views.table(spark, sf_dir, "events").select(cal.parse_report_date(written).alias("date")).where("date IS NOT NULL")
    return dated.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))


@_register(with_views("daily") + "SELECT * FROM daily")
def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir)


@_register(with_views("daily_panel") + "SELECT * FROM daily_panel")
def daily_flow_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily_panel(spark, sf_dir)


@_register(with_views("daily") + "SELECT *, CASE WHEN date <= DATE '2001-06-30' THEN 'train' ELSE 'valid' END AS part FROM daily WHERE date >= DATE '1995-02-01' AND date <= DATE '2001-07-31'")
def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.daily(spark, sf_dir).where(F.col("date").between("1995-02-01", "2001-07-31"))
    return rows.withColumn("part", F.when(F.col("date") <= "2001-06-30", "train").otherwise("valid"))


@_register(with_views("daily") + "SELECT date, 'purchase' AS target, CAST(purchase AS DOUBLE) AS amount FROM daily UNION ALL SELECT date, 'redeem', CAST(redeem AS DOUBLE) FROM daily")
def flows_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unpivot(views.daily(spark, sf_dir), ["date"], T)


@_register(with_views("daily") + "SELECT * FROM daily ORDER BY date LIMIT 20")
def feature_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.preview(views.daily(spark, sf_dir))


@_register(with_views("daily") + "SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, 5 AS n_columns FROM daily")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(views.daily(spark, sf_dir))


@_register(with_views("daily", "daily_yield") + "SELECT d.date, d.purchase, d.redeem, round(y.mfd_daily_yield, 9) AS mfd_daily_yield, y.mfd_7daily_yield FROM daily d LEFT JOIN daily_yield y ON d.date = y.date")
def join_daily_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.join_rates(views.daily(spark, sf_dir), views.daily_yield(spark, sf_dir))
    return out.select("date", *T, F.round("mfd_daily_yield", 9).alias("mfd_daily_yield"), "mfd_7daily_yield")


@_register(with_views("daily", "interbank") + "SELECT d.date, d.purchase, d.redeem, round(Interest_1, 6) AS Interest_1, round(Interest_2, 6) AS Interest_2, round(Interest_3, 6) AS Interest_3 FROM daily d LEFT JOIN interbank i ON d.date = i.date")
def join_interbank_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.join_rates(views.daily(spark, sf_dir), views.interbank(spark, sf_dir))
    return out.select("date", *T, *(F.round(f"Interest_{i}", 6).alias(f"Interest_{i}") for i in (1, 2, 3)))


for _column, _top in (("sex", None), ("city", 10), ("constellation", None)):
    def _counts(spark: SparkSession, sf_dir: str, column: str = _column, top: int | None = _top) -> DataFrame:
        return ledger.value_counts(views.profile(spark, sf_dir), column, top)

    _register(with_views("profile") + f"SELECT coalesce({_column}, 'unknown') AS value, count(*) AS n FROM profile GROUP BY 1" + (" ORDER BY n DESC, value LIMIT 10" if _top else ""),
              f"profile_{_column}" + ("_top10" if _top else ""))(_counts)


# Features

@_register(with_views("daily") + """SELECT date, CAST(isodow(date) - 1 AS INT) AS dayofweek, CAST(day(date) AS INT) AS dayofmonth, CAST(month(date) AS INT) AS month,
CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(day(date) = 1 AS INT) AS is_month_start, CAST(date = last_day(date) AS INT) AS is_month_end FROM daily""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *(c.alias(n) for n, c in cal.calendar(F.col("date")).items()))


@_register(with_views("daily") + "SELECT date, " + ", ".join(
    f"round({f}(2 * pi() * {v} / {p}), 9) AS {n}_{f}" for n, v, p in (("dayofweek", "(isodow(date) - 1)", 7), ("dayofmonth", "day(date)", 31), ("month", "month(date)", 12)) for f in ("sin", "cos")) + " FROM daily")
def fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *_rounded(cal.fourier(F.col("date")), 9))


@_register(with_views("daily") + """, e AS (SELECT *, CAST(day(date) - 1 AS INT) AS s, CAST(day(last_day(date)) - day(date) AS INT) AS e FROM daily)
SELECT date, s AS days_to_month_start, e AS days_to_month_end, CAST(s < 3 AS INT) AS is_first_3_days, CAST(e < 3 AS INT) AS is_last_3_days, CAST(s < 7 AS INT) AS is_first_7_days, CAST(e < 7 AS INT) AS is_last_7_days,
round(exp(-s / 3.0), 9) AS month_start_weight, round(exp(-e / 3.0), 9) AS month_end_weight,
CASE WHEN count(purchase) OVER w = 30 THEN round(avg(purchase) OVER w, 2) END AS purchase_month_start_mean, CASE WHEN count(redeem) OVER w = 30 THEN round(avg(redeem) OVER w, 2) END AS redeem_month_start_mean
FROM e WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def month_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _rounded(cal.month_edges(F.col("date")), 9, ("weight",))
    return views.daily(spark, sf_dir).select("date", *edges, *_rounded(features.month_start_mean(), 2))


@_register(with_views("daily") + f""", h(day) AS (VALUES {", ".join(f"(DATE '{d}')" for d in HOLIDAYS)}),
x AS (SELECT date, (SELECT min(day) FROM h WHERE day >= date) AS n, (SELECT max(day) FROM h WHERE day <= date) AS p FROM daily),
y AS (SELECT date, coalesce(n = date, FALSE) AS is_h, CAST(coalesce(n - date, 30) AS INT) AS n, CAST(coalesce(date - p, 30) AS INT) AS p FROM x)
SELECT date, CAST(is_h AS INT) AS is_holiday, n AS days_to_next_holiday, p AS days_from_last_holiday, CAST(n = 1 AS INT) AS is_day_before_holiday, CAST(p = 1 AS INT) AS is_day_after_holiday FROM y""")
def holiday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *(c.alias(n) for n, c in cal.holidays(F.col("date"), HOLIDAYS).items()))


#: The holidays that a segment keeps; the other segments have none.
_KEPT = {"AUTOMOBILE": "TRUE", "BUILDING": "month(day) <> 10", "MACHINERY": "month(day) = 10"}


def _regional_calendar(spark: SparkSession) -> DataFrame:
    days = spark.createDataFrame([(d,) for d in HOLIDAYS], "day string").select(F.col("day").cast("date").alias("day"))
    parts = [days.where(F.expr(keep)).select(F.lit(segment).alias("segment"), F.col("day").alias("date")) for segment, keep in _KEPT.items()]
    return reduce(DataFrame.unionByName, parts)


@_register(with_views("daily_panel") + f""", h(day) AS (VALUES {", ".join(f"(DATE '{d}')" for d in HOLIDAYS)}),
c AS ({" UNION ALL ".join(f"SELECT '{segment}' AS segment, day FROM h WHERE {keep}" for segment, keep in _KEPT.items())}),
x AS (SELECT p.segment, p.date, n.day AS n, l.day AS p FROM daily_panel p ASOF LEFT JOIN c n ON p.segment = n.segment AND p.date <= n.day ASOF LEFT JOIN c l ON p.segment = l.segment AND p.date >= l.day),
y AS (SELECT segment, date, coalesce(n = date, FALSE) AS is_h, CAST(coalesce(n - date, 30) AS INT) AS n, CAST(coalesce(date - p, 30) AS INT) AS p FROM x)
SELECT segment, date, CAST(is_h AS INT) AS is_holiday, n AS days_to_next_holiday, p AS days_from_last_holiday, CAST(n = 1 AS INT) AS is_day_before_holiday, CAST(p = 1 AS INT) AS is_day_after_holiday FROM y""")
def regional_holiday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = views.daily_panel(spark, sf_dir).select("segment", "date")
    return holidays.regional_holidays(days, _regional_calendar(spark), ["segment"])


def _lag_sql(key: str = "") -> str:
    w = f"({'PARTITION BY ' + key if key else ''} ORDER BY date)"
    return ", ".join(f"lag({t}, {k}) OVER {w} AS {t}_lag_{k}" for t in T for k in features.LAGS)


@_register(with_views("daily") + f"SELECT date, {_lag_sql()} FROM daily")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *(c.alias(n) for n, c in features.lags().items()))


@_register(with_views("daily_panel") + f"SELECT segment, date, {_lag_sql('segment')} FROM daily_panel")
def lag_features_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily_panel(spark, sf_dir).select("segment", "date", *(c.alias(n) for n, c in features.lags(["segment"]).items()))


def _rolling_sql(aggregates: dict[str, str], key: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    out = []
    for t in T:
        for n in features.WINDOWS:
            w = f"({part}ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            out += [f"CASE WHEN count({t}) OVER {w} = {n} THEN round(CAST({sql.format(t)} OVER {w} AS DOUBLE), 2) END AS {t}_roll_{a}_{n}" for a, sql in aggregates.items()]
    return ", ".join(out)


_STATS = {"mean": "avg({})", "std": "stddev_samp({})", "min": "min({})", "max": "max({})"}


@_register(with_views("daily") + f"SELECT date, {_rolling_sql(_STATS)} FROM daily")
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *_rounded(features.rolling(), 2))


@_register(with_views("daily_panel") + f"SELECT segment, date, {_rolling_sql(_STATS, 'segment')} FROM daily_panel")
def rolling_stats_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily_panel(spark, sf_dir).select("segment", "date", *_rounded(features.rolling(["segment"]), 2))


@_register(with_views("daily") + f"SELECT date, {_rolling_sql({'median': 'median({})'})} FROM daily")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *_rounded(features.rolling_median(), 2))


@_register(with_views("daily") + ", l AS (SELECT date, " + ", ".join(f"lag({t}, {7 * k}) OVER (ORDER BY date) AS {t}_same_weekday_w{k}" for t in T for k in (1, 2, 3, 4)) + ", "
           + ", ".join(f"lag({t}, 30) OVER (ORDER BY date) AS {t}_same_day_last_month" for t in T) + " FROM daily) SELECT *, "
           + ", ".join(f"round(list_avg([{t}_same_weekday_w1, {t}_same_weekday_w2, {t}_same_weekday_w3, {t}_same_weekday_w4]), 3) AS {t}_mean_same_weekday_4w" for t in T) + " FROM l")
def same_period_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.same_period()
    return views.daily(spark, sf_dir).select("date", *(F.round(c, 3).alias(n) if "mean" in n else c.alias(n) for n, c in found.items()))


@_register(with_views("daily") + ", l AS (SELECT date, " + ", ".join(f"lag({t}, {k}) OVER (ORDER BY date) AS {t[0]}{k}" for t in T for k in (1, 2, 7, 8)) + """ FROM daily)
SELECT date, round(p1 / (r1 + 1), 9) AS purchase_redeem_ratio_lag1, p1 - p2 AS purchase_diff_lag1_hist, r1 - r2 AS redeem_diff_lag1_hist, p1 - p8 AS purchase_diff_lag7_hist,
r1 - r8 AS redeem_diff_lag7_hist, p1 - r1 AS net_inflow_lag1, p7 - r7 AS net_inflow_lag7 FROM l""")
def ratio_diff_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", *_rounded(features.ratio_diff(), 9, ("ratio",)))


_RATES = ("mfd_daily_yield", "mfd_7daily_yield", "Interest_1", "Interest_2", "Interest_3")
_FILL = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}" for c in _RATES)


@_register(with_views("rated") + f", f AS (SELECT date, {_FILL} FROM rated) SELECT date, {', '.join(f'round({c}, 9) AS {c}' for c in _RATES)} FROM f")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filled(spark, sf_dir).select("date", *(F.round(c, 9).alias(c) for c in _RATES))


@_register(with_views("rated") + f"SELECT CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS month, {', '.join(f'round(avg({c}), {9 if c[0] == "m" else 6}) AS {c}' for c in _RATES)} FROM rated GROUP BY 1")
def prev_month_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.previous_month_means(views.rated(spark, sf_dir), _RATES).select("month", *(F.round(c, 9 if c[0] == "m" else 6).alias(c) for c in _RATES))


@_register(with_views("daily") + "SELECT " + ", ".join(f"round(quantile_cont({t}, {q}), 4) AS {t}_{n}" for t in T for n, q in (("lo", 0.01), ("hi", 0.99))) + " FROM daily")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clip_bounds(views.daily(spark, sf_dir)).select(*(F.round(f"{t}_{n}", 4).alias(f"{t}_{n}") for t in T for n in ("lo", "hi")))


def _digits(name: str) -> int:
    return 9 if any(n in name for n in ("ratio", "_sin", "_cos", "weight", "yield")) else 6 if "Interest" in name else 2


def _features_sql(source: str, columns: tuple[str, ...], key: str = "") -> str:
    """The whole feature table of ``source``: each feature stated once, then filled within the series."""
    part = f"PARTITION BY {key} " if key else ""
    lag = lambda t, k: f"lag({t}, {k}) OVER ({part}ORDER BY date)"
    out = {"dayofweek": "CAST(isodow(date) - 1 AS INT)", "dayofmonth": "CAST(day(date) AS INT)", "month": "CAST(month(date) AS INT)", "is_weekend": "CAST(isodow(date) >= 6 AS INT)",
           "is_month_start": "CAST(day(date) = 1 AS INT)", "is_month_end": "CAST(date = last_day(date) AS INT)"}
    for n, v, p in (("dayofweek", "(isodow(date) - 1)", 7), ("dayofmonth", "day(date)", 31), ("month", "month(date)", 12)):
        out |= {f"{n}_{f}": f"{f}(2 * pi() * {v} / {p})" for f in ("sin", "cos")}
    start, end = "CAST(day(date) - 1 AS INT)", "CAST(day(last_day(date)) - day(date) AS INT)"
    out |= {"days_to_month_start": start, "days_to_month_end": end}
    out |= {f"is_{side}_{n}_days": f"CAST({v} < {n} AS INT)" for n in (3, 7) for side, v in (("first", start), ("last", end))}
    out |= {"month_start_weight": f"exp(-{start} / 3.0)", "month_end_weight": f"exp(-{end} / 3.0)"}
    ahead, behind = "CAST(coalesce(next_h - date, 30) AS INT)", "CAST(coalesce(date - last_h, 30) AS INT)"
    out |= {"is_holiday": "CAST(coalesce(next_h = date, FALSE) AS INT)", "days_to_next_holiday": ahead, "days_from_last_holiday": behind,
            "is_day_before_holiday": f"CAST({ahead} = 1 AS INT)", "is_day_after_holiday": f"CAST({behind} = 1 AS INT)"}
    for t in T:
        out |= {f"{t}_lag_{k}": lag(t, k) for k in features.LAGS}
        for n in features.WINDOWS:
            w = f"({part}ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            out |= {f"{t}_roll_{a}_{n}": f"CASE WHEN count({t}) OVER {w} = {n} THEN CAST({f}({t}) OVER {w} AS {kind}) END"
                    for a, f, kind in (("mean", "avg", "DOUBLE"), ("std", "stddev_samp", "DOUBLE"), ("min", "min", "BIGINT"), ("max", "max", "BIGINT"), ("median", "median", "DOUBLE"))}
        out[f"{t}_month_start_mean"] = out[f"{t}_roll_mean_30"]
        weeks = [lag(t, 7 * k) for k in (1, 2, 3, 4)]
        out |= {f"{t}_same_day_last_month": lag(t, 30)} | {f"{t}_same_weekday_w{k}": w for k, w in enumerate(weeks, 1)} | {f"{t}_mean_same_weekday_4w": f"list_avg([{', '.join(weeks)}])"}
    p, r = (lambda k, t=t: lag(t, k) for t in T)
    out |= {"purchase_redeem_ratio_lag1": f"{p(1)} / ({r(1)} + 1)", "purchase_diff_lag1_hist": f"{p(1)} - {p(2)}", "redeem_diff_lag1_hist": f"{r(1)} - {r(2)}", "purchase_diff_lag7_hist": f"{p(1)} - {p(8)}",
            "redeem_diff_lag7_hist": f"{r(1)} - {r(8)}", "net_inflow_lag1": f"{p(1)} - {r(1)}", "net_inflow_lag7": f"{p(7)} - {r(7)}"}
    fill = f"coalesce(last_value({{0}} IGNORE NULLS) OVER ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({{0}} IGNORE NULLS) OVER ({part}ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"
    whole = {*out, *columns} - {n for n in out if "_mean" in n or "_std" in n or "_median" in n or _digits(n) == 9} - set(_RATES)
    filled = [f"{fill.format(c)} AS {c}" if c in whole else f"round({fill.format(c)}, {_digits(c)}) AS {c}" for c in (*columns, *out)]
    return (f", hol(day) AS (VALUES {', '.join(f"(DATE '{d}')" for d in HOLIDAYS)}), x AS (SELECT *, (SELECT min(day) FROM hol WHERE day >= date) AS next_h, (SELECT max(day) FROM hol WHERE day <= date) AS last_h FROM {source}), "
            f"f AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in out.items())} FROM x) SELECT {key + ', ' if key else ''}date, {', '.join(filled)} FROM f")


_COUNTS = (*T, "user_count", "record_count")


def _rounded_features(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, _digits(n)) for n, kind in df.dtypes if kind == "double"})


@_register(with_views("rated") + _features_sql("rated", (*_COUNTS, *_RATES)))
def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_features(features.add_features(views.rated(spark, sf_dir), holiday_dates=HOLIDAYS))


@_register(with_views("daily_panel") + _features_sql("daily_panel", _COUNTS, "segment"))
def daily_features_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_features(features.add_features(views.daily_panel(spark, sf_dir), ["segment"], HOLIDAYS))


@_register(with_views("rated") + _features_sql("rated", (*_COUNTS, *_RATES)))
@_settled
def daily_features_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of ``daily_features``, by chunks of 500 days."""
    return _rounded_features(long_series.add_features_in_chunks(views.rated(spark, sf_dir), holiday_dates=HOLIDAYS, chunk_rows=500))


@_register(with_views("daily_panel") + _features_sql("daily_panel", _COUNTS, "segment"))
@_settled
def daily_features_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of ``daily_features_panel``, written up to February 2000 and brought up to date after."""
    daily, path = cut_lineage(views.daily_panel(spark, sf_dir)), new_path(spark)
    write_features(features.add_features(daily.where("date < '2000-02-15'"), ["segment"], HOLIDAYS), path)
    update_features(path, daily, "2000-02-15", ["segment"], holiday_dates=HOLIDAYS)
    return _rounded_features(spark.read.parquet(path).drop("month_key"))


@_register(with_views("daily_panel") + "SELECT segment, " + ", ".join(f"round(quantile_cont({t}, {q}), 4) AS {t}_{n}" for t in T for n, q in (("lo", 0.01), ("hi", 0.99))) + " FROM daily_panel GROUP BY segment")
@_settled
def clip_bounds_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.exact_percentiles(views.daily_panel(spark, sf_dir), T, (0.01, 0.99), ["segment"])
    return found.select("segment", *(F.round(F.col(t)[i], 4).alias(f"{t}_{n}") for t in T for i, n in enumerate(("lo", "hi"))))


@_register(with_views("daily") + "SELECT date, " + ", ".join(f"round(ln(1 + {t}), 9) AS {t}_log, CAST(round(exp(ln(1 + {t})) - 1) AS BIGINT) AS {t}_back" for t in T) + " FROM daily")
def log_target_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = {t: scores.log_target(F.col(t)) for t in T}
    return views.daily(spark, sf_dir).select("date", *(x for t, c in logs.items() for x in (F.round(c, 9).alias(f"{t}_log"), F.round(scores.unlog_target(c)).cast("bigint").alias(f"{t}_back"))))


# Evaluation

_ERRORS = ", ".join(f"abs({t}_pred - {t}_true) / CASE WHEN {t}_true = 0 THEN 1.0 ELSE CAST({t}_true AS DOUBLE) END AS {t}_error" for t in T)
_SCORES = ", ".join(f"greatest(0.0, 10.0 * (1 - {t}_error / 0.3)) AS {t}_score" for t in T)
_SCORED = f"e AS (SELECT *, {_ERRORS} FROM forecast), s AS (SELECT *, {_SCORES} FROM e)"
_METRICS = """round(avg(purchase_error), 6) AS purchase_mape, round(avg(redeem_error), 6) AS redeem_mape, round(avg(purchase_score), 6) AS purchase_score, round(avg(redeem_score), 6) AS redeem_score,
round(avg(purchase_score) * 0.45 + avg(redeem_score) * 0.55, 6) AS total_score"""


def _round_doubles(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, kind in df.dtypes if kind == "double"})


@_register(with_views("daily") + "SELECT a.date, a.purchase AS purchase_pred, a.redeem AS redeem_pred, b.purchase AS purchase_true, b.redeem AS redeem_true FROM (SELECT CAST(date + 7 AS DATE) AS date, purchase, redeem FROM daily) a JOIN daily b ON a.date = b.date")
def align_pred_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = views.daily(spark, sf_dir)
    predicted = daily.select(F.date_add("date", 7).alias("date"), F.col("purchase").alias("purchase_pred"), F.col("redeem").alias("redeem_pred"))
    return evaluate.align(predicted, daily)


@_register(with_views("forecast") + f", {_SCORED} SELECT date, " + ", ".join(f"round({t}_{n}, 6) AS {t}_{n}" for t in T for n in ("error", "score")) + " FROM s")
def forecast_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(evaluate.with_errors(views.forecast(spark, sf_dir)).select("date", *(f"{t}_{n}" for t in T for n in ("error", "score"))), 6)


@_register(with_views("forecast") + f", {_SCORED} SELECT {_METRICS} FROM s")
def evaluate_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(evaluate.metrics(views.forecast(spark, sf_dir)), 6)


# A day without a truth has the machine epsilon below its error: the mean then has 16 more digits, and its logarithm is compared.
@_register(with_views("forecast") + "SELECT " + ", ".join(f"round(avg(abs({t}_true - {t}_pred)), 4) AS {t}_mae, round(log10(avg(abs({t}_pred - {t}_true) / greatest(abs(CAST({t}_true AS DOUBLE)), 2.220446049250313e-16))), 9) AS {t}_log10_mape" for t in T) + " FROM forecast")
def forecast_mae_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.mae_mape(views.forecast(spark, sf_dir))
    return found.select(*(c for t in T for c in (F.round(f"{t}_mae", 4).alias(f"{t}_mae"), F.round(F.log10(f"{t}_mape"), 9).alias(f"{t}_log10_mape"))))


_CLASS = """CASE WHEN day(date) = 1 THEN 'month_start' WHEN day(last_day(date)) - day(date) <= 2 THEN 'month_end' WHEN isodow(date) = 7 THEN 'sunday'
WHEN strftime(date, '%m-%d') = '08-08' THEN 'isolated_high' WHEN day(last_day(date)) - day(date) <= 4 THEN 'near_month_end' ELSE 'normal' END AS anomaly"""
_ENRICHED = f"""SELECT date, purchase_true, purchase_pred, redeem_true, redeem_pred, round(purchase_error, 6) AS purchase_error, round(redeem_error, 6) AS redeem_error, round(purchase_score, 6) AS purchase_score,
round(redeem_score, 6) AS redeem_score, abs(purchase_pred - purchase_true) AS purchase_abs_error, abs(redeem_pred - redeem_true) AS redeem_abs_error,
CASE WHEN purchase_pred > purchase_true THEN 'over' ELSE 'under' END AS purchase_direction, CASE WHEN redeem_pred > redeem_true THEN 'over' ELSE 'under' END AS redeem_direction,
round(purchase_score * 0.45 + redeem_score * 0.55, 6) AS daily_weighted_score, purchase_error > 0.3 OR redeem_error > 0.3 AS is_zero_score_day, {_CLASS} FROM s"""


@_register(with_views("forecast") + f", {_SCORED} {_ENRICHED}")
def forecast_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(evaluate.enrich(views.forecast(spark, sf_dir)), 6)


@_register(with_views("forecast") + f", {_SCORED} SELECT * FROM ({_ENRICHED}) WHERE is_zero_score_day")
def zero_score_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(evaluate.zero_score_days(views.forecast(spark, sf_dir)), 6)


@_register(with_views("daily") + f"SELECT date, {_CLASS} FROM daily")
def anomaly_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily(spark, sf_dir).select("date", cal.anomaly_class(F.col("date")).alias("anomaly"))


@_register(with_views("forecast") + f""", {_SCORED}, k AS (SELECT *, strftime(date, '%Y-%m') AS fold, 'lag7' AS strategy FROM s)
SELECT coalesce(fold, 'overall') AS fold, strategy, {_METRICS}, count(*) FILTER (WHERE purchase_error > 0.3) AS purchase_zero_score_days, count(*) FILTER (WHERE redeem_error > 0.3) AS redeem_zero_score_days
FROM k GROUP BY GROUPING SETS ((fold, strategy), (strategy))""")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = views.forecast(spark, sf_dir).withColumns({"fold": F.date_format("date", "yyyy-MM"), "strategy": F.lit("lag7")})
    return _round_doubles(evaluate.backtest_metrics(folds), 6)


@_register(with_views("forecast") + """SELECT CAST(strftime(date, '%Y%m%d') AS INT) AS report_date, CAST(round_even(purchase_pred / 2, 0) AS BIGINT) AS purchase, CAST(round_even(redeem_pred / 2, 0) AS BIGINT) AS redeem FROM forecast""")
def submission_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission(views.forecast(spark, sf_dir).withColumns({f"{t}_pred": F.col(f"{t}_pred") / 2 for t in T}))


# Forecasting

_H = {t: f"h_{t}" for t in T}


def _serving_sql() -> str:
    out = []
    back = lambda a, k: f"coalesce({a}[-{k}], {a}[-1])"
    for t, a in _H.items():
        out += [f"CAST({back(a, k)} AS DOUBLE) AS {t}_lag_{k}" for k in features.LAGS]
        for n in features.WINDOWS:
            w = f"{a}[greatest(len({a}) - {n - 1}, 1):]"
            out += [f"round({f}({w}), 2) AS {t}_roll_{name}_{n}" for name, f in (("mean", "list_avg"), ("std", "list_stddev_pop"), ("min", "list_min"), ("max", "list_max"), ("median", "list_median"))]
        out += [f"round(list_avg({a}[-30:]), 2) AS {t}_month_start_mean", f"CAST(coalesce({a}[-30], 0) AS DOUBLE) AS {t}_same_day_last_month"]
        out += [f"CAST({back(a, 7 * k)} AS DOUBLE) AS {t}_same_weekday_w{k}" for k in (1, 2, 3, 4)]
        out.append(f"round(list_avg([{', '.join(back(a, 7 * k) for k in (1, 2, 3, 4))}]), 2) AS {t}_mean_same_weekday_4w")
    p, r = (lambda k, a=_H[t]: back(a, k) for t in T)
    return ", ".join([*out, f"round({p(1)} / ({r(1)} + 1), 2) AS purchase_redeem_ratio_lag1", *(f"CAST({x} AS DOUBLE) AS {n}" for n, x in (
        ("purchase_diff_lag1_hist", f"{p(1)} - {p(2)}"), ("redeem_diff_lag1_hist", f"{r(1)} - {r(2)}"), ("purchase_diff_lag7_hist", f"{p(1)} - {p(8)}"),
        ("redeem_diff_lag7_hist", f"{r(1)} - {r(8)}"), ("net_inflow_lag1", f"{p(1)} - {r(1)}"), ("net_inflow_lag7", f"{p(7)} - {r(7)}")))])


@_register(with_views("daily_panel") + ", h AS (SELECT segment, " + ", ".join(f"list({t} ORDER BY date) AS {a}" for t, a in _H.items()) + f" FROM daily_panel GROUP BY segment) SELECT segment, {_serving_sql()} FROM h")
def serving_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = forecast.start_state(views.daily_panel(spark, sf_dir), ["segment"])
    return state.select("segment", *_rounded(forecast.serving_features(), 2))


@_register(with_views("forecast") + ", b AS (SELECT " + ", ".join(f"quantile_cont({t}_true, {q}) AS {t}_{n}" for t in T for n, q in (("lo", 0.01), ("hi", 0.99))) + """ FROM forecast),
m AS (SELECT f.*, """ + ", ".join(f"avg({t}_true) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS {t}_mean" for t in T) + """, day(date) >= day(last_day(date)) - 2 AS last3 FROM forecast f)
SELECT date, """ + ", ".join(f"round(greatest(greatest(least((0.99 * {t}_pred + 0.01 * {t}_mean) * CASE WHEN last3 THEN {f} ELSE 1.0 END, {t}_hi), {t}_lo), 0.0), 2) AS {t}_pred" for t, f in (("purchase", 1.2), ("redeem", 1.3)))
           + " FROM m, b WHERE purchase_mean IS NOT NULL")
def postprocess_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.forecast(spark, sf_dir)
    truths = rows.select(*(F.col(f"{t}_true").alias(t) for t in T))
    past = features.in_series().rowsBetween(-7, -1)
    ready = forecast.with_bounds(rows.withColumns({f"{t}_mean": F.avg(f"{t}_true").over(past) for t in T}), truths).where("purchase_mean IS NOT NULL")
    last = forecast.boosted_days(F.col("date"))
    return ready.select("date", *(F.round(forecast.post_process(F.col(f"{t}_pred"), F.col(f"{t}_mean"), F.col(f"{t}_lo"), F.col(f"{t}_hi"), F.when(last, F.lit(b)).otherwise(F.lit(1.0))), 2).alias(f"{t}_pred") for t, b in (("purchase", 1.2), ("redeem", 1.3))))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily totals of the segments. Forecasts see no counts of a day, and to count its users all records would be shuffled once more."""
    return views.daily_panel(spark, sf_dir).select("segment", "date", *T)


def _panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Features of the segments, written once, and the columns that models see."""
    rows = cut_lineage(features.add_features(_totals(spark, sf_dir), ["segment"], HOLIDAYS))
    return rows, features.model_columns(rows, ["segment"])


@_register()
@_settled
def seed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _panel(spark, sf_dir)
    train, valid = rows.where("date < '2001-06-01'"), rows.where("date >= '2001-06-01'")
    return models.fit_ensemble(train, "purchase", columns, series_cols=["segment"]).predict(valid, "purchase_pred").select("segment", "date", "purchase", "purchase_pred")


@_register()
@_settled
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _panel(spark, sf_dir)
    train, valid = rows.where("date < '2001-06-01'"), rows.where("date >= '2001-06-01'")
    return models.fit_one(train, "purchase", columns, ["segment"], kind="boosted").predict(valid, "purchase_pred").select("segment", "date", "purchase", "purchase_pred")


@_register()
@_settled
def rf_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _panel(spark, sf_dir)
    train, valid = rows.where("date < '2001-06-01'"), rows.where("date >= '2001-06-01'")
    return models.fit_one(train, "redeem", columns, ["segment"], kind="forest").predict(valid, "redeem_pred").select("segment", "date", "redeem", "redeem_pred")


@_register(with_views("daily") + """, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM daily), f AS (SELECT *, n - (4 - fold) * (n // 4) AS cut, n // 4 AS size FROM d, range(1, 4) t(fold))
SELECT CAST(fold AS INT) AS fold, min(date) AS train_from, max(date) FILTER (WHERE k <= cut) AS train_to, min(date) FILTER (WHERE k > cut) AS valid_from, max(date) FILTER (WHERE k > cut AND k <= cut + size) AS valid_to,
count(*) FILTER (WHERE k <= cut) AS n_train, count(*) FILTER (WHERE k > cut AND k <= cut + size) AS n_valid FROM f GROUP BY fold""")
def time_series_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cv_folds(views.daily(spark, sf_dir))


@_register(with_views("daily") + """, p AS (SELECT date, purchase, redeem, lag(purchase, 7) OVER (ORDER BY date) AS p7, lag(purchase, 14) OVER (ORDER BY date) AS p14, lag(purchase, 30) OVER (ORDER BY date) AS p30 FROM daily)
SELECT date, round((p7 + p14) / 2, 6) AS mean, round((p7 + p14) / 2 * 0.75 + p30 * 0.25, 6) AS weighted_mean FROM p WHERE p30 IS NOT NULL""")
def ensemble_mean_of_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over an ensemble, with lags as the predictions of its models."""
    rows = views.daily(spark, sf_dir).select("date", *(c.alias(n) for n, c in features.lags().items())).where("purchase_lag_30 IS NOT NULL")
    models_, second = [F.col("purchase_lag_7").cast("double"), F.col("purchase_lag_14").cast("double")], F.col("purchase_lag_30")
    return rows.select("date", F.round(models.mean_prediction(models_), 6).alias("mean"), F.round(models.mean_prediction(models_, second, (0.75, 0.25)), 6).alias("weighted_mean"))


# A day without a truth has the machine epsilon below its error: logarithms are compared, as above.
@_register(with_views("daily") + """, d AS (SELECT *, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n, lag(purchase, 7) OVER (ORDER BY date) AS pp, lag(redeem, 7) OVER (ORDER BY date) AS rp FROM daily),
f AS (SELECT *, n - (4 - fold) * (n // 4) AS cut, n // 4 AS size FROM d, range(1, 4) t(fold)),
e AS (SELECT fold, avg(abs(pp - purchase) / greatest(abs(CAST(purchase AS DOUBLE)), 2.220446049250313e-16)) AS p, avg(abs(rp - redeem) / greatest(abs(CAST(redeem AS DOUBLE)), 2.220446049250313e-16)) AS r
      FROM f WHERE k > cut AND k <= cut + size GROUP BY fold)
SELECT CAST(fold AS INT) AS fold, round(log10(p), 9) AS purchase_log10_mape, round(log10(r), 9) AS redeem_log10_mape, round(log10(0.45 * p + 0.55 * r), 9) AS weighted_log10_mape FROM e""")
def time_series_cv_lag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the folds of ``time_series_cv_folds``, with the value of seven days before as the prediction."""
    rows = views.daily(spark, sf_dir)
    folds = models.cv_folds(rows).select("fold", "valid_from", "valid_to")
    guessed = rows.withColumns({f"{t}_pred": F.lag(t, 7).over(features.in_series()) for t in T})
    scored = guessed.join(F.broadcast(folds), F.col("date").between(F.col("valid_from"), F.col("valid_to")))  # three folds
    found = models.fold_errors(scored)
    return found.select(F.col("fold").cast("int").alias("fold"), *(F.round(F.log10(f"{n}_mape"), 9).alias(f"{n}_log10_mape") for n in (*T, "weighted")))


@_register()
@_settled
def time_series_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _panel(spark, sf_dir)
    return models.cross_validate(rows, columns, series_cols=["segment"])


@_register()
def loss_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # the curve is a few numbers by then
        rows, columns = _panel(spark, sf_dir)
        train, valid = rows.where("date < '2001-06-01'"), rows.where("date >= '2001-06-01'")
        purchase, redeem = side_by_side(lambda j: models.loss_curve(train, valid, j[0], columns, seed=j[1], series_cols=["segment"]), zip(T, (42, 142), strict=True), 2)
    return purchase.unionByName(redeem)


@_register()
@_settled
def one_step_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = _panel(spark, sf_dir)
    return models.one_step_validation(rows.where("date < '2001-06-01'"), rows.where("date >= '2001-06-01'"), columns, series_cols=["segment"])


def _forecast(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """Three seeds for each target, fitted to the days before October 2001, stopped by that month, carried on from the last day."""
    rows, columns = _panel(spark, sf_dir)
    train, tune = rows.where("date < '2001-10-01'"), rows.where("date BETWEEN '2001-10-01' AND '2001-10-31'")
    fitted = side_by_side(lambda t: models.fit_ensemble(train, t, columns, valid=tune, series_cols=["segment"]), T, 2)
    state = forecast.with_bounds(forecast.start_state(rows, ["segment"]), rows, ["segment"])
    state = forecast.with_exogenous(state, rows, features.exogenous_columns(columns, of=rows), ["segment"])
    state = forecast.with_levels(state, *fitted)
    return forecast.recursive_forecast(state, forecast.ensemble_predictor(*fitted), days, ["segment"], HOLIDAYS)


@_register()
@_settled
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir, 30)


@_register()
@_settled
def forecast_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission(_forecast(spark, sf_dir, 30), ["segment"])


@_register()
@_settled
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _panel(spark, sf_dir)
    return backtest.rolling_backtest(rows, ["2001-02", "2001-03", "2001-04", "2001-05", "2001-06"], ["segment"], holiday_dates=HOLIDAYS)[1]


# Recursion with a stub in place of the models: the value of seven days before, which SQL can carry on too.

def _lag7(found: dict) -> tuple:
    return found["purchase_lag_7"], found["redeem_lag_7"]


_STEP = {t: f"greatest(least((0.99 * coalesce(h_{t}[-7], h_{t}[-1]) + 0.01 * list_avg(h_{t}[-7:])) * CASE WHEN day(nxt) >= day(last_day(nxt)) - 2 AND boosted THEN {b} ELSE 1.0 END, {t}_hi), {t}_lo)" for t, b in (("purchase", 1.2), ("redeem", 1.3))}


def _recursion_sql(state: str, keys: str, horizon: str, floor: bool) -> str:
    """``r``: each day of ``state(keys, date, h_purchase, h_redeem, bounds, boosted)`` after its date, one by one."""
    step = {t: f"greatest({v}, 0.0)" if floor else v for t, v in _STEP.items()}
    carried = f"{keys}, boosted, horizon, purchase_lo, purchase_hi, redeem_lo, redeem_hi"
    return f""", r AS (SELECT {carried}, date, h_purchase, h_redeem, CAST(NULL AS DOUBLE) AS purchase_pred, CAST(NULL AS DOUBLE) AS redeem_pred, 0 AS step FROM (SELECT *, {horizon} AS horizon FROM {state})
UNION ALL SELECT {carried}, nxt, list_append(h_purchase, purchase_pred)[-30:], list_append(h_redeem, redeem_pred)[-30:], purchase_pred, redeem_pred, step + 1
FROM (SELECT * EXCLUDE (purchase_pred, redeem_pred), {', '.join(f'{v} AS {t}_pred' for t, v in step.items())} FROM (SELECT *, CAST(date + 1 AS DATE) AS nxt FROM r WHERE step < horizon)))
"""


_PAST = ", ".join(f"CAST(list({t} ORDER BY date)[-30:] AS DOUBLE[]) AS h_{t}, CAST(quantile_cont({t}, 0.01) AS DOUBLE) AS {t}_lo, CAST(quantile_cont({t}, 0.99) AS DOUBLE) AS {t}_hi" for t in T)
_LAG7 = with_views("daily_panel").replace("WITH", "WITH RECURSIVE", 1) + f", s AS (SELECT segment, max(date) AS date, TRUE AS boosted, {_PAST} FROM daily_panel GROUP BY segment)" + _recursion_sql("s", "segment", "30", True)


def _forecast_lag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(_totals(spark, sf_dir))
    state = forecast.with_bounds(forecast.start_state(rows, ["segment"]), rows, ["segment"])
    return forecast.recursive_forecast(state, _lag7, 30, ["segment"], HOLIDAYS)


@_register(_LAG7 + "SELECT segment, date, round(purchase_pred, 2) AS purchase_pred, round(redeem_pred, 2) AS redeem_pred FROM r WHERE step > 0")
@_settled
def recursive_forecast_lag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(_forecast_lag7(spark, sf_dir), 2)


@_register(_LAG7 + "SELECT segment, CAST(strftime(date, '%Y%m%d') AS INT) AS report_date, CAST(round_even(purchase_pred, 0) AS BIGINT) AS purchase, CAST(round_even(redeem_pred, 0) AS BIGINT) AS redeem FROM r WHERE step > 0")
@_settled
def forecast_submission_lag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission(_forecast_lag7(spark, sf_dir), ["segment"])


_MONTHS = [f"2001-0{m}" for m in range(2, 7)]
_BACKTEST = (with_views("daily_panel").replace("WITH", "WITH RECURSIVE", 1) + f", m(fold, first) AS (VALUES {', '.join(f"('{m}', DATE '{m}-01')" for m in _MONTHS)}), st(strategy, boosted) AS (VALUES ('base', FALSE), ('month_end_boost', TRUE)), "
             f"h AS (SELECT fold, segment, any_value(CAST(first - 1 AS DATE)) AS date, {_PAST} FROM daily_panel JOIN m ON date < first GROUP BY fold, segment), s AS (SELECT * FROM h, st)"
             + _recursion_sql("s", "fold, segment, strategy", "day(last_day(date + 1))", False)
             + ", forecast AS (SELECT r.fold, r.segment, r.strategy, r.date, d.purchase AS purchase_true, r.purchase_pred, d.redeem AS redeem_true, r.redeem_pred FROM r JOIN daily_panel d ON r.segment = d.segment AND r.date = d.date WHERE r.step > 0)")


def _backtest_lag7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return backtest.rolling_backtest(cut_lineage(_totals(spark, sf_dir)), _MONTHS, ["segment"], holiday_dates=HOLIDAYS, predictor=_lag7)


@_register(_BACKTEST + " SELECT fold, segment, strategy, date, purchase_true, round(purchase_pred, 2) AS purchase_pred, redeem_true, round(redeem_pred, 2) AS redeem_pred FROM forecast")
@_settled
def backtest_predictions_lag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(_backtest_lag7(spark, sf_dir)[0].drop("purchase_best_iterations", "redeem_best_iterations"), 2)


@_register(_BACKTEST + f""", {_SCORED.replace(', s AS', ', s2 AS')} SELECT coalesce(fold, 'overall') AS fold, segment, strategy, {_METRICS}, count(*) FILTER (WHERE purchase_error > 0.3) AS purchase_zero_score_days, count(*) FILTER (WHERE redeem_error > 0.3) AS redeem_zero_score_days
FROM s2 GROUP BY GROUPING SETS ((fold, segment, strategy), (segment, strategy))""")
@_settled
def rolling_backtest_lag7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_doubles(_backtest_lag7(spark, sf_dir)[1].drop("purchase_best_iterations", "redeem_best_iterations"), 6)
