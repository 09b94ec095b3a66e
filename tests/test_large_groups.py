"""Series and groups that are too large for one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideflow.functions import lineage
from tideflow.operators import features, long_series, selection
from tideflow.sources import sinks


def _rows(spark):
    rows = []
    for s, n in (("a", 400), (None, 130), ("b", 3), ("c", 61)):
        for i in range(n):
            if i % 9 != 4:
                rows.append((s, dt.date(2001, 1, 1) + dt.timedelta(i), (i * 37) % 101 if i % 50 else None, (i * 53) % 89, None if i < 70 or i % 90 else i * 1.5, None))
    return spark.createDataFrame(rows, "series string, date date, purchase long, redeem long, rate double, never double").repartition(5)


@pytest.mark.parametrize("chunk_rows", [30, 47, 10_000])
def test_chunks_have_the_features_of_whole_series(spark, chunk_rows):
    rows = _rows(spark)
    ask = lambda df: sorted(map(str, df.collect()))
    whole = features.add_features(rows, ["series"])
    got = long_series.add_features_in_chunks(rows, ["series"], chunk_rows=chunk_rows)
    assert got.columns == whole.columns and ask(got) == ask(whole)


def test_one_series_is_the_work_of_several_tasks(spark):
    rows = _rows(spark).where("series = 'a'").drop("series")
    got = long_series.add_features_in_chunks(rows, chunk_rows=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(__chunk" in plan
    assert sorted(map(str, got.collect())) == sorted(map(str, features.add_features(rows).collect()))
    assert long_series.add_features_in_chunks(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="30 rows at least"):
        long_series.add_features_in_chunks(rows, chunk_rows=29)


def test_numbers_follow_the_order(spark):
    got = long_series.numbered(_rows(spark), ["series"]).orderBy("__at").select("__at", "series", "date").collect()
    assert [r["__at"] for r in got] == list(range(len(got)))
    assert [(r.series or "", r.date) for r in got] == sorted((r.series or "", r.date) for r in got)


@pytest.mark.parametrize("parts", [2, 256])
def test_percentiles_by_selection(spark, parts):
    inf, nan = float("inf"), float("nan")
    rows = [("few", 1.0, 5), ("few", 2.0, None), ("one", 7.5, 1), ("same", 3.0, 3), *[("same", 3.0, 3)] * 40, ("none", None, None), (None, -1e300, -4), (None, 1e300, 9), (None, 5e-324, 2), (None, 0.0, 2)]
    rows += [("odd", v, 1) for v in (inf, -inf, 1.0, nan, 2.0, -3.5)] + [("many", float((i * 7919) % 1000) ** 3, i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    shares = (0.01, 0.25, 0.5, 0.99, 1.0, 0.0)
    expected = {r.g: (r.x, r.n) for r in df.groupBy("g").agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("x", "n"))).collect()}
    got = {r.g: (r.x, r.n) for r in selection.exact_percentiles(df, ["x", "n"], shares, ["g"], parts).collect()}
    assert str(got.pop("odd")[0]) == str(expected.pop("odd")[0]) and got == expected
    alone = df.where("g = 'many'")
    assert selection.exact_percentiles(alone, ["x"], shares).first().x == expected["many"][0]
    assert selection.exact_percentiles(alone.limit(0), ["x"], shares).first().x is None


def test_a_large_group_is_never_gathered(spark, monkeypatch):
    df = spark.range(1_000_000, numPartitions=4).select(F.pmod(F.col("id") * 2654435761, F.lit(1 << 40)).alias("v"))
    written, cut = [], lineage.cut_lineage
    monkeypatch.setattr(selection, "cut_lineage", lambda d, keep=False: written.append(cut(d, keep)) or written[-1])
    got = selection.exact_percentiles(df, ["v"], (0.01, 0.99)).first().v
    assert got == df.agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99)))).first()[0]
    assert len(written) <= 6 and all(w.count() <= 4 for w in written[1:])  # beside the values, the open ranks alone


def test_kinds_of_features_are_kept_with_their_columns(spark, tmp_path):
    table = features.add_features(_rows(spark), ["series"])
    table = table.withColumnRenamed("purchase_lag_7", "week_before").withColumnRenamed("dayofmonth_sin", "wave")
    table = table.withColumn("moon", features.of_kind(F.dayofmonth("date") % 29, "moon", features.CALENDAR)).withColumn("price", F.col("rate") * 2)
    sinks.write_features(table, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    columns = [c for c in features.model_columns(back, ["series"]) if c != "month_key"]
    assert set(features.exogenous_columns(columns, of=back)) == {"rate", "never", "price"}
    assert set(features.exogenous_columns(columns, freeze_month_mean=True, of=back)) == {"rate", "never", "price", "purchase_month_start_mean", "redeem_month_start_mean"}
    assert set(features.exogenous_columns(columns)) == {"rate", "never", "price", "week_before", "wave", "moon"}  # by name alone
    chunked = long_series.add_features_in_chunks(_rows(spark), ["series"])
    assert [f.metadata for f in chunked.schema] == [f.metadata for f in features.add_features(_rows(spark), ["series"]).schema]
