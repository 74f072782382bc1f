"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__
from registry.check import connect, differences
from registry.oracle import SQL
from registry.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "trade_panel", "trade_panel_brand", "panel_sample", "null_report", "key_cardinality", "export_share",
    "feature_table_test", "min_rank", "rank_within_top_n", "event_knn_predictions", "validation_report",
    "trend_table_long", "top_n_new_goods", "user_similarity_raw", "recommend_from_store",
    "als_fixed_start", "als_rounds", "stored_prep_tables", "stored_year_replaced", "refreshed_trends", "table_shapes", "panel_head",
]

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_sql_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(__spark_entry__.queries()) >= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_entry_gives_rows(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "pred_pct_change" in out.columns


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql_twin(spark, name):
    want = connect(FOLDER).execute(SQL[name]).df()
    assert differences(QUERIES[name](spark, FOLDER).toPandas(), want) is None


@needs_data
def test_date_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["trend_table"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "l_quantity" not in plan and "o_totalprice" not in plan
