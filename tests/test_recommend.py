import pytest

from growthlens.operators.recommend import location_id_of, rank_within, top_n, top_n_all, with_names

from conftest import by_key

SCORED = "location_id long, product_id long, year int, export_period_train double, pred_pct_change double, export_pct_change_rank long"


@pytest.fixture(scope="module")
def scored(frame):
    rows = [
        (1, 10, 2014, 0.0, 5.0, 9), (1, 11, 2014, 1.0, 5.0, 1), (1, 12, 2014, 1.0, 7.0, 5),
        (1, 13, 2013, 1.0, 99.0, 1), (2, 10, 2014, 0.0, 1.0, 3), (1, 14, 2014, 0.0, None, 2),
    ]
    return frame(rows, SCORED)


def test_top_n_breaks_ties_by_product_and_keeps_the_year(scored):
    assert [r["product_id"] for r in top_n(scored, 1, 2014, 2).collect()] == [12, 10]
    assert [r["product_id"] for r in top_n(scored, 1, 2014, 9).collect()] == [12, 10, 11, 14]
    assert [r["product_id"] for r in top_n(scored, 1, 2014, 9, new_goods_only=True).collect()] == [10, 14]


def test_top_n_for_all_equals_top_n_for_each(scored):
    got = by_key(top_n_all(scored, 2014, 2), "location_id", "position")
    assert {k: r["product_id"] for k, r in got.items()} == {(1, 1): 12, (1, 2): 10, (2, 1): 10}


def test_top_n_all_limits_before_the_shuffle(scored):
    plan = top_n_all(scored, 2014, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


def test_rank_within_both_ways(scored):
    top = top_n(scored, 1, 2014, 3)
    ranks = by_key(rank_within(top), "product_id")
    assert [ranks[(p,)]["export_pct_change_rank_loc"] for p in (11, 12, 10)] == [1, 2, 3]
    ranks = by_key(rank_within(top, inverted=True), "product_id")
    assert [ranks[(p,)]["export_pct_change_rank_loc"] for p in (11, 12, 10)] == [3, 2, 1]


def test_names_are_outer_joined(frame, scored):
    classes = frame([(10, "ten", "x"), (12, "twelve", "x"), (77, "other", "x")], "index long, name string, level string")
    got = by_key(with_names(top_n(scored, 1, 2014, 3), classes), "product_id")
    assert {k[0]: r["name"] for k, r in got.items()} == {12: "twelve", 10: "ten", 11: None}


def test_location_lookup_needs_exactly_one_match(frame):
    locations = frame([(3, "Ireland"), (4, "Peru"), (5, "Peru")], "index long, name_en string")
    assert location_id_of(locations, "Ireland") == 3
    for name in ("Peru", "ireland"):
        with pytest.raises(LookupError):
            location_id_of(locations, name)
