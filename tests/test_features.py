"""Feature rows against a pandas computation that follows the definitions directly."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from growthlens.config import PeriodSpec, Splits
from growthlens.operators import features
from growthlens.operators.features import FEATURE_COLUMNS, build_features, global_moments
from growthlens.plans.materialise import materialise
from growthlens.plans.pipeline import write_panel

SPLITS = Splits(PeriodSpec(1995, 1997, 1999), PeriodSpec(1999, 2001, 2003))
PANEL = "location_id long, product_id long, year int, export_value double, import_value double"


def random_panel(seed, locations=5, products=12):
    """Sparse; location 0 has most rows, location 4 exports nothing, some pairs start late."""
    rng, rows = random.Random(seed), []
    for location in range(locations):
        for product in range(products * (4 if location == 0 else 1)):
            for year in range(1995, 2003):
                if rng.random() < 0.35:
                    continue
                value = 0.0 if location == 4 or rng.random() < 0.3 else round(rng.lognormvariate(3, 2), 2)
                rows.append((location, product, year, value, round(rng.uniform(-5, 50), 2)))
    return rows


def scaled(series, kind):
    low, high = series.min(), series.max()
    if not high > low:
        return series * 0.0
    return (series - low) / (high - low) if kind == "norm" else (series - series.mean()) / series.std()


def expected(panel, spec):
    totals = panel.groupby(["location_id", "year"])["export_value"].sum().rename("export_total_loc_year")
    split = panel[(panel.year >= spec.start) & (panel.year < spec.end)]
    key = ["location_id", "product_id"]
    first = split[split.year < spec.mid].groupby(key).export_value.sum().rename("export_period1")
    second = split[split.year >= spec.mid].groupby(key).export_value.sum().rename("export_period2")
    whole = split.groupby(key).export_value.sum().rename("export_period_total")
    pairs = pd.concat([first, whole, second], axis=1).dropna(subset=["export_period1"]).reset_index()

    def trend(p):
        if np.isnan(p.export_period2):
            return 0.0
        return abs(p.export_period2) if p.export_period1 == 0 else p.export_period2 / p.export_period1 - 1

    pairs["export_trend"] = pairs.apply(trend, axis=1)
    rows = split.merge(totals.reset_index(), on=["location_id", "year"]).merge(pairs, on=key)
    rows["export_pct"] = rows.export_value / rows.export_total_loc_year.replace(0, np.nan)
    for kind in ("norm", "std"):
        for name, column, by in (
            ("export_val_{}_all", "export_value", None),
            ("export_pct_{}_all", "export_pct", None),
            ("export_val_{}", "export_value", ["location_id", "year"]),
            ("export_pct_{}", "export_pct", ["location_id", "year"]),
            ("export_trend_{}", "export_trend", ["location_id"]),
        ):
            source = rows[column]
            rows[name.format(kind)] = (
                scaled(source, kind) if by is None else rows.groupby(by)[column].transform(lambda s: scaled(s, kind))
            )
    rows["export_trend_class"] = np.sign(rows.export_trend).astype(int)
    rows["export_trend_pct_rank"] = rows.export_trend.round(12).rank(pct=True)
    return rows.fillna(0)[FEATURE_COLUMNS]


@pytest.mark.parametrize("seed,broadcast_rows", [(1, 1_000), (2, 0)])
def test_features_equal_the_direct_computation(frame, seed, broadcast_rows):
    rows = random_panel(seed)
    panel = materialise(frame(rows, PANEL).repartition(3))
    pdf = pd.DataFrame(rows, columns=["location_id", "product_id", "year", "export_value", "import_value"])
    for spec in (SPLITS.train, SPLITS.test):
        got = build_features(panel, spec, broadcast_rows).rows.toPandas()
        key = ["location_id", "product_id", "year"]
        got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, expected(pdf, spec)))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_global_moments_equal_those_of_the_rows(frame):
    panel = materialise(frame(random_panel(3), PANEL))
    features = build_features(panel, SPLITS.train)
    moments = panel.sparkSession.range(1).select(
        *[c.alias(n) for n, c in global_moments(features.groups).items()]
    ).first()
    direct = features.rows.agg(
        F.min("export_value"), F.max("export_value"), F.avg("export_value"), F.stddev_samp("export_value")
    ).first()
    assert [moments[f"value_{m}"] for m in ("min", "max", "mean", "std")] == pytest.approx(list(direct))


def test_feature_plan_stays_in_the_jvm_and_off_single_partitions(frame):
    panel = materialise(frame(random_panel(4), PANEL))
    plan = build_features(panel, SPLITS.train).rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_empty_split(frame):
    panel = materialise(frame([(1, 1, 1950, 1.0, 1.0)], PANEL))
    assert build_features(panel, SPLITS.train).rows.count() == 0


def test_colocated_run_is_equal_and_joins_without_shuffling_the_panel(spark, frame):
    panel = frame(random_panel(6), PANEL)
    plain, _ = write_panel(panel, False)
    bucketed, colocated = write_panel(panel, True)
    assert colocated and write_panel(panel)[1] is False  # far below the automatic bound
    want = build_features(plain, SPLITS.train).rows.toPandas()
    got = build_features(bucketed, SPLITS.train, colocate=True)
    key = ["location_id", "product_id", "year"]
    got_rows = got.rows.toPandas()
    pd.testing.assert_frame_equal(
        got_rows.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for colocal in (
            bucketed.groupBy("location_id", "product_id").agg(F.sum("export_value")),
            bucketed.join(got.pairs, ["location_id", "product_id"]),
        ):
            assert "Exchange" not in colocal._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pair_table_of_a_colocated_run_is_written_once(frame, monkeypatch):
    panel, _ = write_panel(frame(random_panel(6), PANEL), True)
    names, written = [], features.materialise
    monkeypatch.setattr(features, "materialise", lambda df, name="frame": names.append(name) or written(df, name))
    for ranks in (True, False):
        found = features.pair_features(panel, SPLITS.train, colocate=True, ranks=ranks)
        assert found.count() == features.trend_table(panel, SPLITS.train).count() > 0
        assert found.filter("export_trend_pct_rank is not null").isEmpty() is not ranks
    assert names == ["pairs", "pairs"]
