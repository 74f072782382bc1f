import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from growthlens.operators.metrics import cosine, huber, log_cosh, long_report, loss_report
from growthlens.operators.profile import profile
from growthlens.operators.ranking import BUCKET_ROWS, _bucket_count, exact_quantiles, global_rank, rank_sample
from growthlens.plans.materialise import materialise

from conftest import by_key

SCHEMA = "id long, v double"


def ranks(df, **options):
    got = by_key(global_rank(df, {"v": "r"}, ["id"], **options), "id")
    return [got[k]["r"] for k in sorted(got)]


def test_worked_ranks(frame):
    df = frame(list(enumerate([3.0, 1.0, 3.0, 2.0])), SCHEMA)
    assert ranks(df) == [1, 4, 1, 3]
    assert ranks(df, method="average", ascending=True, pct=True) == [0.875, 0.25, 0.875, 0.5]


def test_null_nan_and_negative_zero(frame):
    df = frame(list(enumerate([0.0, None, -0.0, float("nan"), 5.0])), SCHEMA)
    assert ranks(df) == [2, None, 2, None, 1]
    assert ranks(df, method="average", ascending=True, pct=True) == [0.5, None, 0.5, None, 1.0]


def test_empty_and_all_null(frame):
    assert ranks(frame([], SCHEMA)) == []
    assert ranks(frame([(0, None)], SCHEMA)) == [None]


def test_weights_count_rows(frame):
    rows = [(0, 5.0, 3), (1, 4.0, 2), (2, 4.0, 1), (3, 1.0, 4)]
    df = frame(rows, "id long, v double, w int")
    expanded = [v for _, v, w in rows for _ in range(w)]
    want = [1 + sum(x > v for x in expanded) for _, v, _ in rows]
    assert ranks(df, weight="w") == want
    average = [(sum(x < v for x in expanded) + (expanded.count(v) + 1) / 2) / len(expanded) for _, v, _ in rows]
    assert ranks(df, weight="w", method="average", ascending=True, pct=True) == pytest.approx(average)


def test_unknown_method(frame):
    with pytest.raises(ValueError):
        ranks(frame([(0, 1.0)], SCHEMA), method="dense")


def window_rank(df, ascending):
    order = F.col("v").asc_nulls_last() if ascending else F.col("v").desc_nulls_last()
    n = df.filter("v is not null").count()
    first = F.rank().over(Window.orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy("v"))
    out = df.select(
        "id",
        F.when(F.col("v").isNotNull(), first).alias("lowest"),
        F.when(F.col("v").isNotNull(), (first + (ties - 1) / 2) / n).alias("pct"),
    )
    return by_key(out, "id")


def skewed_values(n, seed):
    """A third zeros, another heavy value, many ties and some NULLs."""
    rng = random.Random(seed)
    choices = [
        lambda: 0.0,
        lambda: rng.choice([7.0, -2.5]),
        lambda: float(rng.randint(-40, 40)),
        lambda: rng.gauss(0, 1e6),
        lambda: None if rng.random() < 0.2 else 0.0,
    ]
    return [rng.choice(choices)() for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_single_partition_window_on_skewed_ties(frame, seed):
    df = materialise(frame(list(enumerate(skewed_values(3_000, seed))), SCHEMA).repartition(5))
    for ascending in (True, False):
        want = window_rank(df, ascending)
        lowest = by_key(global_rank(df, {"v": "r"}, ["id"], ascending=ascending), "id")
        average = by_key(global_rank(df, {"v": "r"}, ["id"], "average", ascending, True), "id")
        for key, row in want.items():
            assert lowest[key]["r"] == row["lowest"]
            assert average[key]["r"] == (pytest.approx(row["pct"], abs=1e-12) if row["pct"] is not None else None)


def test_several_columns_at_once(frame):
    rows = [(i, float(i % 7), float(-i)) for i in range(200)]
    df = materialise(frame(rows, "id long, a double, b double"))
    got = by_key(global_rank(df, {"a": "ra", "b": "rb"}, ["id"]), "id")
    for i, a, b in rows:
        assert got[(i,)]["ra"] == 1 + sum(x > a for _, x, _ in rows)
        assert got[(i,)]["rb"] == 1 + sum(x > b for _, _, x in rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e9, 1e9)), min_size=1, max_size=60))
def test_rank_property(frame, values):
    known = [v for v in values if v is not None]
    want = [None if v is None else 1 + sum(x > v for x in known) for v in values]
    assert ranks(frame(list(enumerate(values)), SCHEMA)) == want


def test_rank_plan_has_no_single_partition_sort(frame):
    df = materialise(frame([(i, float(i)) for i in range(100)], SCHEMA))
    plan = global_rank(df, {"v": "r"}, ["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_the_cuts_meet_in_no_task(frame):
    df = materialise(frame([(i, float(i % 90)) for i in range(30_000)], SCHEMA))
    sample = rank_sample(df, ["v"], 30_000, 8)
    assert "Exchange" not in sample._jdf.queryExecution().toString()
    assert 8_000 < sample.count() < 12_000


def test_buckets_follow_from_the_rows(frame):
    df = frame([(1, 1.0)], SCHEMA)
    assert _bucket_count(df, 10**12) == 10**12 // BUCKET_ROWS and _bucket_count(df, 1) >= 2


def test_exact_quantiles_and_profile(frame):
    values = [float(v) for v in skewed_values(999, 5) if v is not None]
    df = materialise(frame([(i, v) for i, v in enumerate(values)], SCHEMA))
    ordered = sorted(values)

    def want(p):
        at = p * (len(ordered) - 1)
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        return ordered[low] + (ordered[high] - ordered[low]) * (at - low)

    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = by_key(exact_quantiles(df, ["v"], probabilities), "probability")
    for p in probabilities:
        assert got[(p,)]["value"] == pytest.approx(want(p), abs=1e-9)
    described = profile(df, ["v"]).first()
    assert described["count"] == len(values) and described["50%"] == pytest.approx(want(0.5), abs=1e-9)


def test_metrics_by_hand(frame):
    df = frame([(1.0, -1.0), (0.0, -1.0), (-1.0, 0.0)], "a double, b double")
    got = by_key(
        long_report(
            df,
            {
                "cosine": cosine("a", "b"),
                "huber": huber("a", "b"),
                "logcosh": log_cosh("a", "b"),
            },
        ),
        "metric",
    )
    assert got[("cosine",)]["value"] == pytest.approx(-0.5)
    assert got[("huber",)]["value"] == pytest.approx((1.5 + 0.5 + 0.5) / 3)
    import math

    assert got[("logcosh",)]["value"] == pytest.approx(sum(math.log(math.cosh(d)) for d in (2, 1, 1)) / 3)


def test_metrics_on_zero_vectors_and_huge_differences(frame):
    df = frame([(0.0, 1e6)], "a double, b double")
    got = by_key(loss_report(df, "a", "b"), "metric")
    assert got[("cosine",)]["value"] == 0.0
    assert got[("logcosh",)]["value"] == pytest.approx(1e6, rel=1e-5)


def test_columns_together_give_what_each_alone_gives(frame):
    a, b, c = (skewed_values(1_500, s) for s in (5, 6, 7))
    rows = [(i if i else None, *v, 1 + i % 3) for i, v in enumerate(zip(a, b, c))] + [(9_999, None, None, None, 2)]
    df = materialise(frame(rows, "id long, a double, b double, c double, w int").repartition(3))
    for options in ({}, {"weight": "w"}, {"method": "average", "ascending": True, "pct": True, "weight": "w"}):
        together = by_key(global_rank(df, {"a": "ra", "b": "rb", "c": "rc"}, ["id"], **options), "id")
        for column in "abc":
            alone = by_key(global_rank(df, {column: "r"}, ["id"], **options), "id")
            assert {k: r["r"] for k, r in alone.items()} == {k: r[f"r{column}"] for k, r in together.items()}
    assert together[(9_999,)]["ra"] is None and len(together) == 1_501


def test_four_ranks_share_one_window_over_narrow_rows(spark):
    wide = [(F.col("id") * k % 97).cast("double").alias(f"v{k}") for k in range(4)] + [F.lit("x" * 50).alias(f"text{k}") for k in range(5)]
    df = materialise(spark.range(0, 5_000, 1, 4).select("id", *wide))
    ranked = global_rank(df, {f"v{k}": f"r{k}" for k in range(4)}, ["id"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # Running sums and ties are two frames of one window, over one sort of rows without the texts.
    assert len(windows) <= 2 and plan.count("Exchange hashpartitioning(_column") == 1
    dealt = next(line for line in plan.splitlines() if "Exchange hashpartitioning(_column" in line)
    below = plan[plan.index(dealt) :]
    assert "text0" not in below


def test_ranks_of_several_columns_shuffle_no_weights_of_buckets(frame):
    df = materialise(frame([(None, 1.0, -2.0), *[(i, float(i % 3), -float(i)) for i in range(9)]], "k long, a double, b double"))
    ranked = global_rank(df, {"a": "ra", "b": "rb"}, ["k"])
    lines = ranked._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(_column" in line]
    assert dealt and not any("_below" in lines[i + 1] or "_inside" in lines[i + 1] for i in dealt)
    got = by_key(ranked, "k")
    assert got[(None,)]["ra"] == 4 and got[(None,)]["rb"] == 3 and got[(8,)]["ra"] == 1 and got[(8,)]["rb"] == 10
