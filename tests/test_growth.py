import pytest
from pyspark.sql import functions as F

from growthlens.config import PeriodSpec
from growthlens.functions.growth import (
    actual_growth,
    carry_trend,
    change_class,
    predicted_growth,
    sign_class,
)
from growthlens.functions.scaling import destandardise, share, unminmax
from growthlens.operators.aggregates import group_sum, key_cardinality, null_report, period_sums, trend_table
from growthlens.operators.baseline import carry_forward, growth_baseline, score
from growthlens.operators.panel import cast_ids, clean_panel, filter_in

from conftest import by_key

PANEL = "location_id long, product_id long, year int, export_value double, import_value double"
SPEC = PeriodSpec(1995, 2000, 2005)


def row(product, year, export, imported=0.0, location=1):
    return (location, product, year, export, imported)


@pytest.fixture(scope="module")
def panel(frame):
    rows = [
        row(10, 1995, 60.0), row(10, 1999, 40.0), row(10, 2000, 150.0),
        row(11, 1995, 0.0), row(11, 2001, 0.0),
        row(12, 1996, 0.0), row(12, 2002, 70.0),
        row(13, 1996, 1.0, 0.0), row(13, 2002, 1.0, -5.0),
        row(14, 1997, 20.0),
        row(15, 2003, 30.0),
        row(10, 2005, 999.0),
    ]
    return frame(rows, PANEL)


def test_trend_of_each_case(panel):
    got = by_key(trend_table(panel, SPEC), "product_id")
    assert set(got) == {(10,), (11,), (12,), (13,), (14,)}  # 15 has no first half
    assert {p: got[(p,)]["export_trend"] for p in (10, 11, 12, 14)} == {10: 0.5, 11: 0.0, 12: 70.0, 14: 0.0}
    assert got[(13,)]["import_trend"] == 5.0
    assert got[(14,)]["export_period2"] == 0.0 and got[(14,)]["export_period_total"] == 20.0
    assert got[(10,)]["rows"] == 3  # 2005 is outside


def test_period_sums_keep_missing_half_null(panel):
    got = by_key(period_sums(panel, SPEC), "product_id")
    assert got[(14,)]["export_period2"] is None
    assert got[(15,)]["export_period1"] is None and got[(15,)]["rows1"] == 0


def test_period_sums_build_no_lists_of_rows(panel):
    plan = period_sums(panel, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "collect_list" not in plan


def test_trend_does_not_depend_on_row_order(panel):
    shuffled = panel.orderBy(F.rand(3)).repartition(3)
    assert sorted(trend_table(panel, SPEC).collect()) == sorted(trend_table(shuffled, SPEC).collect())


def test_actual_change_and_class(frame):
    cases = [
        (0.0, 5.0, 5.0, 2), (None, 5.0, 5.0, 2), (None, 0.0, 0.0, 0), (0.0, 0.0, 0.0, 0),
        (10.0, 4.0, -0.6, -1), (10.0, 10.0, 0.0, 0), (10.0, 15.0, 0.5, 1), (0.0, -3.0, 3.0, None),
        (None, -3.0, -3.0, -1),
    ]
    df = frame([(i, *c) for i, c in enumerate(cases)], "i int, train double, test double, want double, cls int")
    df = df.withColumn("change", actual_growth(F.col("test"), F.col("train")))
    df = df.withColumn("class", change_class(F.col("test"), F.coalesce("train", F.lit(0.0)), F.col("change")))
    for r in df.collect():
        assert r["change"] == pytest.approx(r["want"]), r
        assert r["class"] == r["cls"], r


def test_predicted_change_keeps_the_sign_on_a_zero_base(frame):
    df = frame([(0.0, -3.0), (None, -3.0), (10.0, 5.0)], "train double, p double")
    got = [r[0] for r in df.select(predicted_growth(F.col("p"), F.col("train"))).collect()]
    assert got == [-3.0, -3.0, -0.5]


def test_small_expressions(frame):
    df = frame([(2.0, 8.0)], "a double, b double").select(
        sign_class(F.col("a")).alias("up"),
        sign_class(F.lit(None).cast("double")).alias("unknown"),
        carry_trend(F.lit(10.0), F.lit(20.0)).alias("carried"),
        carry_trend(F.lit(10.0), F.lit(1.0)).alias("floor"),
        share(F.col("a"), F.col("b")).alias("share"),
        share(F.col("a"), F.lit(0.0)).alias("no_share"),
        unminmax(F.lit(0.5), F.col("a"), F.col("b")).alias("mid"),
        destandardise(F.lit(2.0), F.lit(10.0), F.lit(3.0)).alias("plain"),
    )
    assert df.first().asDict() == {
        "up": 1, "unknown": 0, "carried": 70.0, "floor": 0.0, "share": 0.25, "no_share": None,
        "mid": 5.0, "plain": 16.0,
    }


def test_clean_panel_fills_then_drops_negative_exports(frame):
    df = frame(
        [row(1, 1995, None, None), row(2, 1995, -1.0), row(3, 1995, 2.0, -4.0), row(4, 1995, float("nan"))], PANEL
    )
    got = by_key(clean_panel(df), "product_id")
    assert set(got) == {(1,), (3,), (4,)}
    assert got[(1,)]["export_value"] == 0.0 and got[(1,)]["import_value"] == 0.0
    assert got[(3,)]["import_value"] == -4.0 and got[(4,)]["export_value"] == 0.0


def test_clean_panel_names_what_is_missing(frame):
    with pytest.raises(ValueError, match="import_value"):
        clean_panel(frame([(1, 1, 1995, 1.0)], "location_id long, product_id long, year int, export_value double"))


def test_filter_in_range_list_and_null(frame):
    df = frame([(1,), (2,), (3,), (None,)], "x int")
    assert sorted(r[0] for r in filter_in(df, "x", range(2, 5)).collect()) == [2, 3]
    assert [r[0] for r in filter_in(df, "x", [1, 9]).collect()] == [1]
    assert filter_in(df, "x", range(0)).count() == 0


def test_cast_ids_from_text(frame):
    got = cast_ids(frame([("7", "9000000000", "1995")], "location_id string, product_id string, year string"))
    assert got.first().asDict() == {"location_id": 7, "product_id": 9_000_000_000, "year": 1995}


def test_group_sum_null_report_and_cardinality(frame):
    df = frame([("a", 1.0, 2.0), ("a", None, 3.0), ("b", 4.0, None), (None, 4.0, None)], "g string, x double, y double")
    sums = by_key(group_sum(df, "g", {"x": "sx", "y": "sy"}), "g")
    assert sums[("a",)] == {"g": "a", "sx": 1.0, "sy": 5.0} and sums[("b",)]["sy"] is None
    nulls = by_key(null_report(df), "column")
    assert {c[0]: r["nulls"] for c, r in nulls.items()} == {"g": 1, "x": 1, "y": 2}
    for approximate in (False, True):
        got = by_key(key_cardinality(df, ["x", "y"], approximate), "column")
        assert got[("x",)]["distinct_values"] == 3 and got[("x",)]["max_value"] == 4.0


PAIRS = "location_id long, product_id long, rows long, export_period_total double, export_trend_class int, export_trend_pct_rank double"


def test_baseline_and_carried_features_join_by_pair(frame):
    train = frame([(1, 1, 2, 10.0, 1, 0.9), (1, 2, 1, 0.0, -1, 0.3)], PAIRS)
    test = frame([(1, 1, 1, 15.0, 0, 0.0), (1, 2, 1, 5.0, 0, 0.0), (2, 1, 1, 7.0, 0, 0.0)], PAIRS)
    got = by_key(growth_baseline(train, test), "location_id", "product_id")
    assert [got[k]["export_pct_change"] for k in ((1, 1), (1, 2), (2, 1))] == [0.5, 5.0, 7.0]
    assert got[(2, 1)]["export_period_train"] == 0.0 and got[(2, 1)]["export_class"] == 2
    carried = by_key(carry_forward(test, train), "location_id", "product_id")
    assert carried[(2, 1)]["export_trend_class"] == 0
    assert carried[(2, 1)]["export_trend_pct_rank"] == pytest.approx((0.9 * 2 + 0.3) / 3)  # by rows


def test_score_bases(frame):
    base = frame([(1, 1, 20.0)], "location_id long, product_id long, export_period_train double")
    predicted = frame([(1, 1, 5.0)], "location_id long, product_id long, predictions double")
    assert score(base, predicted).first()["pred_pct_change"] == -0.75
    assert score(base, predicted, "period_mean", 10).first()["pred_pct_change"] == 1.5
    with pytest.raises(ValueError):
        score(base, predicted, "period_mean")
    with pytest.raises(ValueError):
        score(base, predicted, "median")


def test_period_spec_must_be_ordered():
    with pytest.raises(ValueError):
        PeriodSpec(2000, 2000, 2005)
