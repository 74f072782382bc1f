"""Decimal checks, day periods and sums in a fixed order."""

import functools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthlens.config import PeriodSpec
from growthlens.operators.aggregates import period_sums, shape
from growthlens.sources import transactions
from growthlens.sources.transactions import build_panel, events_as_panel

from conftest import by_key

EVENTS = "ts timestamp_ntz, user_id long, value double, props string"


def tables(spark, price, discount):
    return {
        "lineitem": spark.createDataFrame(
            [(1, 5, 7, price, discount)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double",
        ),
        "orders": spark.sql("select 1L o_orderkey, 3L o_custkey, timestamp_ntz'1996-02-03 00:00:00' o_orderdate"),
        "supplier": spark.sql("select 7L s_suppkey, 1 s_nationkey"),
        "customer": spark.sql("select 3L c_custkey, 2 c_nationkey"),
    }


def test_finer_values_stop_the_run_unless_allowed(spark):
    exact = by_key(build_panel(tables(spark, 10.25, 0.1)), "location_id")
    assert exact[(1,)]["export_value"] == 9.225 and exact[(2,)]["import_value"] == 9.225
    with pytest.raises(PySparkException, match="decimal places"):
        build_panel(tables(spark, 10.255, 0.1)).collect()
    with pytest.raises(PySparkException, match="decimal places"):
        build_panel(tables(spark, 10.25, 0.125)).collect()
    finer = by_key(build_panel(tables(spark, 10.255, 0.125), price_places=3, discount_places=3), "location_id")
    assert finer[(1,)]["export_value"] == pytest.approx(10.255 * 0.875, abs=1e-12)


def test_days_of_different_months_stay_apart(spark):
    rows = [("2024-01-05 10:00:00", 1.5), ("2024-01-05 23:59:59", 1.0), ("2024-02-05 00:00:00", 2.0), ("2025-01-05 00:00:00", 4.0)]
    frame = spark.createDataFrame([(t, 1, v, '{"k": 9}') for t, v in rows], "t string, user_id long, value double, props string")
    frame = frame.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["year"]: r["export_value"] for r in events_as_panel(frame).collect()}
    assert got == {5: 2.5, 36: 2.0, 371: 4.0}
    assert {r["year"] for r in events_as_panel(frame, "2024-01-05").collect()} == {1, 32, 367}
    fine = frame.withColumn("value", F.lit(0.125))
    with pytest.raises(PySparkException, match="decimal places"):
        events_as_panel(fine).collect()


def test_sums_do_not_depend_on_the_order_of_rows(frame):
    values = [1e16, 1.0, -1e16, 3.0, 0.1, 0.7]
    rows = [(1, 1, 1995 + i, v, -v) for i, v in enumerate(values)]
    spec = PeriodSpec(1995, 1998, 2001)
    schema = "location_id long, product_id long, year int, export_value double, import_value double"
    found = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        r = period_sums(frame(order, schema).repartition(3), spec).first()
        found.add((r["export_period1"], r["export_period2"], r["export_period_total"], r["rows1"], r["rows"]))
    assert found == {(((0.0 + 1e16) + 1.0) + -1e16, (3.0 + 0.1) + 0.7, functools.reduce(float.__add__, values, 0.0), 3, 6)}
    assert shape(frame(rows, schema)) == (6, 5)


def test_the_tasks_that_group_lines_follow_from_the_lines(spark, frame, monkeypatch):
    """Their number was the session's, whatever the lines; a task held more cells the larger the table."""
    lines = [(i % 7, i % 5, i % 3, float(i), 0.1) for i in range(40)] + [(1, None, 0, 2.0, 0.0), (None, 1, 0, 2.0, 0.0)]
    given = {
        "lineitem": frame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double"),
        "orders": spark.sql("select id o_orderkey, id % 2 o_custkey, timestamp_ntz'1996-02-03 00:00:00' o_orderdate from range(7)"),
        "supplier": spark.sql("select id s_suppkey, int(id) s_nationkey from range(3)"),
        "customer": spark.sql("select id c_custkey, int(id) c_nationkey from range(2)"),
    }
    want = sorted(build_panel(given).collect(), key=str)
    monkeypatch.setattr(transactions, "TASK_LINES", 2)
    panel = build_panel(given)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 21), REPARTITION_BY_NUM") == 3
    assert sorted(panel.collect(), key=str) == want


def test_tasks_are_dealt_though_shuffle_partitions_are_many(spark, frame, monkeypatch):
    lines = [(i % 7, i % 5, i % 3, float(i), 0.1) for i in range(42)]
    given = {
        "lineitem": frame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double"),
        "orders": spark.sql("select id o_orderkey, id % 2 o_custkey, timestamp_ntz'1996-02-03 00:00:00' o_orderdate from range(7)"),
        "supplier": spark.sql("select id s_suppkey, int(id) s_nationkey from range(3)"),
        "customer": spark.sql("select id c_custkey, int(id) c_nationkey from range(2)"),
        "part": spark.sql("select id p_partkey, 'n' p_name, concat('b', id % 2) p_brand, 't' p_type from range(5)"),
    }
    want = {product: sorted(build_panel(given, product).collect(), key=str) for product in ("p_partkey", "p_brand")}
    monkeypatch.setattr(transactions, "TASK_LINES", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for product, exchanges in (("p_partkey", 3), ("p_brand", 2)):
            panel = build_panel(given, product)
            plan = panel._jdf.queryExecution().executedPlan().toString()
            assert plan.count(", 21), REPARTITION_BY_NUM") == exchanges
            assert sorted(panel.collect(), key=str) == want[product]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
