"""Refreshing by appended years against the full run."""

import random

import pytest
from pyspark.sql import functions as F

from growthlens.config import PAIR, PeriodSpec
from growthlens.operators.aggregates import period_sums, trend_table
from growthlens.operators.features import build_features, global_moments
from growthlens.operators.refresh import appended, load_state, period_state, refresh_year, save_state, state_trends
from growthlens.plans.materialise import materialise
from growthlens.sources.catalog import TableCatalog

from conftest import by_key

SPEC = PeriodSpec(1995, 1997, 2000)
PANEL = "location_id long, product_id long, year int, export_value double, import_value double"


@pytest.fixture(scope="module")
def panel(frame):
    rng = random.Random(8)
    rows = [
        (loc, prod, year, rng.choice([0.0, rng.uniform(0, 1e6), 0.1]), rng.choice([0.0, rng.uniform(-5, 5)]))
        for loc in range(5)
        for prod in range(30)
        for year in range(1993, 2002)
        if rng.random() < 0.4
    ]
    return materialise(frame(rows, PANEL))


@pytest.fixture()
def stored(spark, panel, tmp_path):
    catalog = TableCatalog(spark, str(tmp_path / "store"))
    catalog.write("panel", panel, partition_by=["year"])
    save_state(catalog, "train", period_state(panel.filter("year <= 1996"), SPEC))
    return catalog


def test_year_by_year_equals_the_full_run_to_the_last_bit(stored, panel):
    for year in (1997, 1998, 1999):
        state = refresh_year(stored, "panel", "train", year)
    assert state.last_year == 1999 and load_state(stored, "train").spec == SPEC
    assert by_key(state.sums, *PAIR) == by_key(period_sums(panel, SPEC), *PAIR)
    assert by_key(state_trends(state), *PAIR) == by_key(trend_table(panel, SPEC), *PAIR)


def test_moments_follow_from_the_kept_groups(stored, panel):
    for year in (1997, 1998, 1999):
        state = refresh_year(stored, "panel", "train", year)
    full = build_features(panel, SPEC, ranks=False)
    want = by_key(full.groups.select("location_id", "year", *state.groups.columns[2:]), "location_id", "year")
    got = by_key(state.groups, "location_id", "year")
    assert set(got) == set(want)
    for key, row in got.items():
        for name, value in row.items():
            assert value == (pytest.approx(want[key][name], rel=1e-12) if want[key][name] is not None else None), (key, name)
    one = state.groups.limit(1)
    a, b = (one.select(*[c.alias(k) for k, c in global_moments(g).items()]).first() for g in (state.groups, full.groups))
    assert a.asDict() == pytest.approx(b.asDict())


def test_only_the_new_years_files_are_read(stored, panel):
    state = load_state(stored, "train")
    rows = stored.read("panel").filter("year = 1997")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    scanned = rows._jdf.queryExecution().executedPlan().execute()
    merged = appended(state, rows)
    assert scanned.getNumPartitions() >= 1 and merged.last_year == 1997
    count = panel.filter("year = 1997").count()
    assert rows.count() == count < panel.count() / 4
    # Pairs without a row in the new year stand as they stood.
    new = rows.select(*PAIR).distinct()
    before, after = (by_key(s.join(new, PAIR, "left_anti"), *PAIR) for s in (state.sums, merged.sums))
    assert before == after


def test_years_out_of_order_or_outside_are_refused_or_ignored(stored, panel):
    state = load_state(stored, "train")
    for years in ("year = 1996", "year in (1997, 1998)"):
        with pytest.raises(ValueError):
            appended(state, panel.filter(years))
    assert appended(state, panel.filter("year = 2001")) is state
    empty = period_state(panel.limit(0), SPEC)
    grown = appended(appended(empty, panel.filter("year = 1995")), panel.filter("year = 1996"))
    assert by_key(grown.sums, *PAIR) == by_key(state.sums, *PAIR)
