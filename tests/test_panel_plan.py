"""What the panel of the segments costs: line items are shuffled once before their totals, and not for counts that no model sees."""

import datetime as dt

import pytest

from tideflow.plans import catalogue, views


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _optimized(df):
    return list(_nodes(df._jdf.queryExecution().optimizedPlan()))


def _over_line_items(node):
    return any("l_orderkey" in below.output().toString() for below in _nodes(node))


@pytest.mark.parametrize("query", ["daily_flow_panel", "serving_features"])
def test_line_items_meet_the_customers_with_their_orders(spark, data_dir, query):
    joins = [n for n in _optimized(catalogue.queries()[query](spark, data_dir)) if n.nodeName() == "Join"]
    assert len(joins) == 2 and sum(map(_over_line_items, joins)) == 1


@pytest.mark.parametrize("name", ["_panel", "_forecast_lag7", "_backtest_lag7"])
def test_forecasts_start_from_totals_without_counts(spark, data_dir, monkeypatch, name):
    written, cut = [], catalogue.cut_lineage

    def record(df, *args, **options):
        written.append(df)
        return cut(df, *args, **options)

    monkeypatch.setattr(catalogue, "cut_lineage", record)
    getattr(catalogue, name)(spark, data_dir)
    first = written[0]
    assert not {"user_count", "record_count"} & set(first.columns)
    assert not any("count(distinct" in n.toString() for n in _optimized(first) if n.nodeName() == "Aggregate")
    assert {"purchase", "redeem"} <= set(first.columns)


def test_the_order_of_joins_keeps_unmatched_null_and_repeated_rows_as_they_were(spark, tmp_path):
    day = dt.datetime(2001, 1, 1)
    spark.createDataFrame([(1, day, "R", 1.005), (1, day, "N", 2.0), (2, day, "A", 4.0), (3, None, "A", 8.0), (4, day, "A", 16.0), (5, day, "A", 32.0), (None, day, "A", 64.0), (6, day, None, 0.5)],
                          "l_orderkey long, l_shipdate timestamp, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (2, 11), (3, 10), (4, None), (6, 10), (None, 10)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, "A"), (10, "B"), (11, None), (None, "C")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = views.daily_panel(spark, str(tmp_path)).select("segment", "purchase", "redeem", "user_count", "record_count").collect()
    old = spark.sql(f"""SELECT c_mktsegment AS segment, cast(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag <> 'R' THEN round(l_extendedprice * 100) ELSE 0 END), 0) AS bigint),
        cast(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 100) ELSE 0 END), 0) AS bigint), count(DISTINCT o_custkey), count(l_shipdate)
        FROM parquet.`{tmp_path}/lineitem.parquet` JOIN parquet.`{tmp_path}/orders.parquet` ON l_orderkey = o_orderkey JOIN parquet.`{tmp_path}/customer.parquet` ON o_custkey = c_custkey
        WHERE l_shipdate IS NOT NULL GROUP BY c_mktsegment""").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, old), key=str) and len(got) == 3
