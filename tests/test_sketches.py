"""Sketched quantiles against exact ranks, merged by parts and in several steps."""

import pytest
from pyspark.sql import functions as F

from growthlens.operators.ranking import exact_quantiles
from growthlens.operators.sketches import column_sketches, merged_sketches, rank_error, sketched_quantiles, true_ranks
from growthlens.plans.materialise import materialise
from growthlens.sources.catalog import TableCatalog

from conftest import by_key

P = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    value = F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pow((F.xxhash64("id") % 100_000) / 1_000.0, 3))
    rows = spark.range(0, 60_000, 1, 8).select((F.col("id") % 37).cast("int").alias("part"), value.alias("a"), F.col("id").alias("b"))
    return materialise(rows)


@pytest.mark.parametrize("k", [100, 1_000])
def test_merged_parts_stay_within_the_stated_error(table, k):
    whole = merged_sketches(column_sketches(table, ["a", "b"], ["part"], k))
    found = true_ranks(table, sketched_quantiles(whole, P)).collect()
    assert len(found) == 2 * len(P) and all(r["n"] == 60_000 for r in found)
    assert max(r["off"] for r in found) <= 2 * rank_error(k)
    exact = by_key(exact_quantiles(table, ["a", "b"], [0.0, 1.0]), "column", "probability")
    for r in found:
        if r["probability"] in (0.0, 1.0):
            assert r["value"] == exact[r["column"], r["probability"]]["value"]


def test_merging_in_steps_and_keeping_parts(table):
    parts = column_sketches(table, ["b"], ["part"]).withColumn("group", F.col("part") % 5)
    groups = merged_sketches(parts, ["group"])
    assert groups.count() == 5
    again = sketched_quantiles(merged_sketches(groups), [0.5]).first()
    assert again["n"] == 60_000 and abs(again["value"] - 30_000) <= 2 * rank_error() * 60_000
    one = sketched_quantiles(groups.filter("group = 1"), [0.5]).first()
    assert one["n"] == table.filter("part % 5 = 1").count()


def test_stored_sketches_take_a_new_part_without_old_rows(spark, table, tmp_path):
    catalog = TableCatalog(spark, str(tmp_path))
    catalog.write("sketches", column_sketches(table.filter("part < 36"), ["a"], ["part"]), partition_by=["part"])
    catalog.replace_partitions("sketches", column_sketches(table.filter("part = 36"), ["a"], ["part"]))
    whole = merged_sketches(catalog.read("sketches"))
    found = true_ranks(table, sketched_quantiles(whole, [0.5, 0.9])).collect()
    assert all(r["n"] == 60_000 and r["off"] <= 2 * rank_error() for r in found)


def test_odd_columns(frame):
    df = frame([(1, None, float("nan")), (1, 2.0, None), (2, None, None)], "part int, x double, y double")
    found = by_key(sketched_quantiles(column_sketches(df, ["x", "y"], ["part"]), [0.5]), "part", "column")
    assert set(found) == {(1, "x")} and found[1, "x"]["value"] == 2.0
    assert column_sketches(df.limit(0), ["x"]).count() == 0
    with pytest.raises(ValueError):
        column_sketches(df, ["z"])
