"""Regional holidays, months brought up to date, lines set aside, and quality figures gathered on the way."""

import datetime as dt
from pathlib import Path

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tideflow.functions import calendar as cal
from tideflow.operators import features, holidays, ledger
from tideflow.plans import catalogue
from tideflow.sources import checked, sinks


def test_regional_holidays_equal_their_sql(spark, data_dir):
    assert_same(spark, data_dir, catalogue.queries()["regional_holiday_features"], catalogue.oracle_sql()["regional_holiday_features"])


def test_regional_holidays(spark):
    start, names = dt.date(2014, 1, 1), ("is_holiday", "days_to_next_holiday", "days_from_last_holiday", "is_day_before_holiday", "is_day_after_holiday")
    rows = [(r, start + dt.timedelta(i), i) for r in ("cn", None, "none") for i in range(0, 300, 3) for _ in range(2)] + [("cn", None, 1)]
    days = spark.createDataFrame(rows, "region string, date date, n long")
    table = spark.createDataFrame([("cn", d) for d in cal.HOLIDAYS_2014] * 2 + [(None, "2014-05-05"), ("cn", None), ("elsewhere", "2014-03-03")], "region string, date string").withColumn("date", F.col("date").cast("date"))
    got = holidays.regional_holidays(days, table, ["region"])
    assert got.columns == ["region", "date", "n", *names] and got.count() == len(rows)
    literal = days.where("region = 'cn' AND date IS NOT NULL").select("date", *(c.alias(n) for n, c in cal.holidays(F.col("date")).items()))
    assert sorted(map(tuple, literal.collect())) == sorted(map(tuple, got.where("region = 'cn' AND date IS NOT NULL").select("date", *names).collect()))
    for r in got.where("region IS NULL").collect():
        off = (dt.date(2014, 5, 5) - r.date).days
        assert (r.is_holiday, r.days_to_next_holiday, r.days_from_last_holiday) == (int(off == 0), off if off >= 0 else 30, -off if off <= 0 else 30)
    assert {tuple(r[n] for n in names) for r in got.where("region = 'none'").collect()} == {(0, 30, 30, 0, 0)}
    assert tuple(got.where("date IS NULL").first()[n] for n in names) == (None,) * 5
    alone = holidays.regional_holidays(days.select("date"), table.where("region = 'cn'").select("date"))
    assert alone.where("is_holiday = 1").count() == 3 * got.where("region = 'cn' AND is_holiday = 1").count()
    assert holidays.regional_holidays(days, table.limit(0), ["region"]).where("is_holiday = 1 OR days_to_next_holiday <> 30").count() == 0


def _daily(spark, last):
    rows = []
    for s, skip in (("a", 5), (None, 7), ("late", 4)):
        for i in range(150):
            day = dt.date(2001, 1, 1) + dt.timedelta(i)
            if day <= last and i % skip and not (s == "late" and i < 100):
                rows.append((s, day, (i * 37) % 101, (i * 53) % 89, i % 5, i % 9, None if i % 11 else float(i), 1.5 if i == 12 else None))
    return spark.createDataFrame(rows, "series string, date date, purchase long, redeem long, user_count long, record_count long, rate double, rare double")


def _files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("gaps", ["rows", "fill"])
def test_months_are_brought_up_to_date(spark, tmp_path, gaps):
    path, whole = str(tmp_path / "f"), str(tmp_path / "whole")
    sinks.write_features(features.add_features(_daily(spark, dt.date(2001, 4, 10)), ["series"], calendar_gaps=gaps), path)
    before = _files(path)
    daily = _daily(spark, dt.date(2001, 5, 20))
    assert sinks.update_features(path, daily, "2001-04-11", ["series"], calendar_gaps=gaps) == ["2001-04", "2001-05"]
    after = _files(path)
    touched = {p.parts[0] for p in after.keys() ^ before.keys()} | {p.parts[0] for p in after if before.get(p) not in (None, after[p])}
    assert touched == {"month_key=2001-04", "month_key=2001-05"} and len({p.parts[0] for p in after}) == 5
    sinks.write_features(features.add_features(daily, ["series"], calendar_gaps=gaps), whole)
    read = lambda p: sorted(map(str, spark.read.parquet(p).select(*spark.read.parquet(whole).columns).collect()))
    assert read(path) == read(whole)


LEDGER = "report_date DATE, user_id BIGINT, amount DOUBLE, note STRING"


def test_lines_are_set_aside(spark, tmp_path):
    good = ["20130701,1,10.5,first", "20130702,2,,", " 20130703 , 3 ,7,third"]
    bad = ["20130704,4", "20130705,5,1.0,fifth,more", "20131301,6,1.0,sixth", "20130707,x,y,seventh", "20130708,8,1.0,eigh�th"]
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((good[:2] + bad[:3], good[2:] + bad[3:])):
        (tmp_path / f"in/part{i}.csv").write_text("\n".join(["﻿ report_date,user_id , amount,note", *lines]), encoding="utf-8")
    got = checked.read_checked(spark, str(tmp_path / "in"), LEDGER, str(tmp_path / "out"))
    assert got.rows.dtypes == [("report_date", "date"), ("user_id", "bigint"), ("amount", "double"), ("note", "string")]
    assert sorted(tuple(r) for r in got.rows.collect()) == [(dt.date(2013, 7, 1), 1, 10.5, "first"), (dt.date(2013, 7, 2), 2, None, None), (dt.date(2013, 7, 3), 3, 7.0, "third")]
    assert {r.line: (r.reason, r["columns"]) for r in got.rejected.collect()} == {
        bad[0]: ("fields", []), bad[1]: ("fields", []), bad[2]: ("value", ["report_date"]), bad[3]: ("value", ["user_id", "amount"]), bad[4]: ("encoding", ["note"])}
    assert got.counts == {"read": 8, "rows": 3, "fields": 2, "encoding": 1, "value": 2}
    again = checked.read_checked(spark, str(tmp_path / "in/part1.csv"), "user_id INT", str(tmp_path / "out"))  # further columns stay as text
    assert again.counts == {"read": 3, "rows": 1, "fields": 0, "encoding": 1, "value": 1}
    assert dict(again.rows.dtypes)["amount"] == "string"
    with pytest.raises(ValueError, match="lacks the columns: city"):
        checked.read_checked(spark, str(tmp_path / "in"), "city STRING", str(tmp_path / "out"))
    (tmp_path / "empty.csv").write_text("report_date,user_id,amount,note\n")
    none = checked.read_checked(spark, str(tmp_path / "empty.csv"), LEDGER, str(tmp_path / "none"))
    assert none.rows.count() == none.rejected.count() == 0 and none.counts["read"] == 0


def test_files_are_read_once_for_both_parts(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("user_id,amount\n" + "\n".join(f"{i},{i if i % 10 else 'x'}" for i in range(1000)))
    reads = []
    plan = lambda df: reads.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")) or write(df)
    write = type(spark.range(1)).write.fget
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "write", property(plan))
        got = checked.read_checked(spark, str(path), "user_id INT, amount INT", str(tmp_path / "t"))
    assert reads == [1] and got.counts["rows"] == 900 == got.rows.count() and got.rejected.count() == 100


def test_totals_and_quality_in_one_pass(spark, data_dir, tmp_path):
    from tideflow.plans import views

    balances = views.balances(spark, data_dir)
    options = {"purchase": "total_purchase_amt", "redeem": "total_redeem_amt"}
    daily, report = ledger.write_daily_with_quality(balances, str(tmp_path / "d"), **options)
    assert report.collect() == ledger.balance_quality(balances).collect() and report.dtypes == ledger.balance_quality(balances).dtypes
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, ledger.daily_flow(balances, **options).collect()))
    none, empty = ledger.write_daily_with_quality(balances.limit(0), str(tmp_path / "e"), **options)
    assert none.count() == 0 and empty.collect() == ledger.balance_quality(balances.limit(0)).collect()
    _, skipped = ledger.write_daily_with_quality(balances.drop("tBalance"), str(tmp_path / "s"), **options)
    assert skipped.first().status == "skipped"
    scans = []
    original = ledger.daily_flow
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ledger, "daily_flow", lambda *a, **k: scans.append(original(*a, **k)) or scans[-1])
        ledger.write_daily_with_quality(spark.read.parquet(f"{data_dir}/events.parquet").selectExpr("CAST(ts AS DATE) AS date", "user_id", "value AS tBalance", "value AS yBalance", "1 AS total_purchase_amt", "1 AS total_redeem_amt"), str(tmp_path / "o"), **options)
    assert scans[0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
