import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideflow.functions import calendar as cal
from tideflow.functions import scores
from tideflow.operators import evaluate, ledger
from tideflow.sources import sinks, tables


def test_balance_report_variants(spark):
    rows = [("100", "50", 60, 10), ("100", "50", 60, 0), ("x", "50", 1, 1), (None, "5", 1, 1), ("NaN", "5", 1, 1)]
    got = ledger.balance_quality(spark.createDataFrame(rows, "tBalance string, yBalance string, total_purchase_amt int, total_redeem_amt int")).first()
    assert (got.status, got.total_records, got.valid_records, got.consistent_records, got.inconsistent_records, got.max_abs_error) == ("warning", 5, 2, 1, 1, 10.0)
    lacking = ledger.balance_quality(spark.createDataFrame([(1,)], "tBalance int")).first()
    assert lacking.status == "skipped" and "yBalance" in lacking.message and lacking.total_records == 1 and lacking.valid_records is None and len(lacking) == 10
    none = ledger.balance_quality(spark.createDataFrame([], "tBalance int, yBalance int, total_purchase_amt int, total_redeem_amt int")).first()
    assert none.status == "passed" and none.inconsistent_ratio is None


def test_daily_flow_nulls_and_missing_user(spark):
    d = dt.date(2001, 1, 1)
    rows = spark.createDataFrame([(d, None, None), (d, None, None), (None, 5, 5)], "date date, purchase_amt long, redeem_amt long")
    got = ledger.daily_flow(rows).collect()
    assert [tuple(r) for r in got] == [(d, 0, 0, 2, 2)]


def test_daily_flow_combines_before_its_shuffle(spark):
    rows = spark.range(10).select(F.current_date().alias("date"), F.col("id").alias("purchase_amt"), F.col("id").alias("redeem_amt"), F.col("id").alias("user_id"))
    plan = ledger.daily_flow(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan


def test_duplicate_rate_is_reported(spark):
    d = dt.date(2001, 1, 1)
    daily = spark.createDataFrame([(d, 1)], "date date, purchase long")
    with pytest.raises(Exception, match="two rates on 2001-01-01"):
        ledger.join_rates(daily, spark.createDataFrame([(d, 1.0), (d, 2.0)], "date date, rate double")).collect()
    rates = spark.createDataFrame([(d, 1.0, None), (None, 2.0, 1), (None, 3.0, 1)], "date date, rate double, other int")
    assert [tuple(r) for r in ledger.join_rates(daily, rates).collect()] == [(d, 1, 1.0, None)]


def test_parse_report_date(spark):
    got = spark.createDataFrame([("20130701",), ("20131301",), ("20130701.0",), ("2013070",), (None,)], "s string").select(cal.parse_report_date(F.col("s")).alias("d"))
    assert [r.d for r in got.collect()] == [dt.date(2013, 7, 1), None, None, None, None]


def test_default_holidays_fall_back_to_thirty(spark):
    days = spark.createDataFrame([(dt.date(2013, 7, 1),), (dt.date(2014, 10, 7),), (dt.date(2014, 10, 8),)], "d date")
    got = days.select(*(c.alias(n) for n, c in cal.holidays(F.col("d")).items())).collect()
    assert [tuple(r) for r in got] == [(0, 184, 30, 0, 0), (1, 0, 0, 0, 0), (0, 30, 1, 0, 1)]


def test_month_edges(spark):
    days = spark.createDataFrame([(dt.date(2001, 2, 28),), (dt.date(2000, 2, 27),), (dt.date(2001, 4, 1),)], "d date")
    got = days.select(*(c.alias(n) for n, c in cal.month_edges(F.col("d")).items())).collect()
    assert [(r.days_to_month_start, r.days_to_month_end, r.is_last_3_days) for r in got] == [(27, 0, 1), (26, 2, 1), (0, 29, 0)]


def test_scores_at_their_edges(spark):
    rows = spark.createDataFrame([(10.0, 13.0), (0.0, 0.2), (10.0, 10.0), (None, 1.0)], "y double, p double")
    error = scores.relative_error(F.col("y"), F.col("p"))
    got = rows.select(error.alias("e"), scores.linear_score(error).alias("s"), scores.direction(F.col("y"), F.col("p")).alias("d")).collect()
    assert got[0].s == pytest.approx(0, abs=1e-9) and got[1].e == pytest.approx(0.2) and got[2].s == 10 and got[2].d == "under" and got[3].s is None


def test_error_of_exactly_the_zero_is_no_zero_day(spark):
    rows = spark.createDataFrame([(dt.date(2001, 1, 15), 10, 7, 10, 10)], "date date, purchase_true long, purchase_pred long, redeem_true long, redeem_pred long")
    got = evaluate.enrich(rows).first()
    assert got.purchase_error == 0.3 and not got.is_zero_score_day


def test_submission_rounds_half_to_even(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2014, 9, 1), 2.5, 3.5)], "date date, purchase_pred double, redeem_pred double")
    assert tuple(sinks.submission(rows).first()) == (20140901, 2, 4)
    sinks.write_submission(rows, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s/plain")).first()[0] == "20140901"
    assert spark.read.csv(str(tmp_path / "s/headed"), header=True).columns == ["report_date", "purchase", "redeem"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "My_User_Balance_1.csv").write_bytes("﻿ report_date ,user_id,total_purchase_amt,total_redeem_amt,note\n20130701,1,5,6,ä\n20130702,x,7,8,b\n".encode())
    (tmp_path / "user_balance.txt").write_text("other")
    assert len(tables.find_files(spark, str(tmp_path), "user_balance")) == 1
    got = tables.read_csv(spark, tables.find_files(spark, str(tmp_path), "user_balance"), tables.LEDGER)
    assert got.columns == ["report_date", "user_id", "total_purchase_amt", "total_redeem_amt", "note"]
    assert [tuple(r) for r in got.orderBy("report_date").collect()] == [("20130701", 1, 5, 6, "ä"), ("20130702", None, 7, 8, "b")]
    with pytest.raises(FileNotFoundError, match="My_User_Balance_1.csv"):
        tables.find_files(spark, str(tmp_path), "shibor")
    with pytest.raises(ValueError, match="tBalance"):
        tables.require_columns(got, ["tBalance"])
    (tmp_path / "latin.csv").write_bytes("a\nä\n".encode("latin-1"))
    with pytest.raises(Exception, match="latin.csv is not utf-8"):
        tables.read_csv(spark, str(tmp_path / "latin.csv")).collect()
    assert tables.read_csv(spark, str(tmp_path / "latin.csv"), check=False).count() == 1
    assert tables.read_csv(spark, str(tmp_path / "latin.csv"), encoding="iso-8859-1").first()[0] == "ä"
    assert tables.read_if_exists(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        tables.read_features(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("encoding", ["gbk", "gb18030"])
def test_chinese_encodings(spark, tmp_path, encoding):
    (tmp_path / "c.csv").write_bytes("user_id,city\n1,杭州\n".encode(encoding))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c.csv"), "user_id BIGINT, city STRING", encoding).collect()] == [(1, "杭州")]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_the_four_tables_of_a_folder(spark, tmp_path):
    (tmp_path / "user_balance_table.csv").write_text("report_date,user_id,tBalance,yBalance,total_purchase_amt,total_redeem_amt\n20130701,1,10,5,5,0\n")
    (tmp_path / "user_profile_table.csv").write_text("user_id,sex,city,constellation\n1,1,6411949,x\n")
    (tmp_path / "mfd_day_share_interest.csv").write_text("mfd_date,mfd_daily_yield,mfd_7daily_yield\n20130701,1.5,4.9\n")
    (tmp_path / "mfd_bank_shibor.csv").write_text("mfd_date,Interest_O_N,Interest_1_W\n20130701,4.4,5.5\n")
    found = tables.load_tables(spark, str(tmp_path))
    assert set(found) == {"ledger", "profile", "daily_yield", "interbank"} and all(t.count() == 1 for t in found.values())
    assert dict(found["ledger"].dtypes)["tBalance"] == "bigint" and dict(found["interbank"].dtypes)["Interest_1_W"] == "double" and found["daily_yield"].first().mfd_7daily_yield == 4.9
    report = ledger.balance_quality(found["ledger"])
    sinks.write_csv(report, str(tmp_path / "report"))
    back = spark.read.csv(str(tmp_path / "report"), header=True).first()
    assert list(back.asDict()) == [r.split()[0] for r in ledger.REPORT] and back.status == "passed" and back.valid_records == "1"
