"""Change between the two periods, carried features, and scored pairs.

Everything here is constant within a (location, product) pair, so it is
computed once per pair. ``rows`` says how many panel rows a pair stands for;
ranks and metrics weigh by it, and ``expand`` puts the values back on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.config import PAIR, PeriodSpec
from growthlens.functions.growth import actual_growth, carry_trend, change_class, predicted_growth
from growthlens.operators.aggregates import struct_scalar
from growthlens.operators.ranking import global_rank

RANKS = {
    "export_pct_change": "export_pct_change_rank",
    "pred_pct_change": "pred_pct_change_rank",
    "export_period_train": "export_period_train_rank",
    "export_period_test": "export_period_test_rank",
}


def growth_baseline(train_pairs: DataFrame, test_pairs: DataFrame) -> DataFrame:
    """Every test pair with its training total, percent change and change class."""
    train = train_pairs.select(*PAIR, F.col("export_period_total").alias("train_total"))
    test = test_pairs.select(*PAIR, F.col("export_period_total").alias("export_period_test"), "rows")
    change = actual_growth(F.col("export_period_test"), F.col("train_total"))
    return (
        test.join(train, PAIR, "left")
        .withColumn("export_pct_change", change)
        .withColumn("export_period_train", F.coalesce("train_total", F.lit(0.0)))
        .withColumn(
            "export_class",
            change_class(
                F.col("export_period_test"), F.col("export_period_train"), F.col("export_pct_change")
            ),
        )
        .select(*PAIR, "rows", "export_period_train", "export_period_test", "export_pct_change", "export_class")
    )


def mean_rank(train_pairs: DataFrame) -> Column:
    """Mean percentile rank over the training rows, as a scalar subquery."""
    weighted = F.sum(F.col("export_trend_pct_rank") * F.col("rows"))
    return struct_scalar(train_pairs, mean=F.try_divide(weighted, F.sum("rows"))).getField("mean")


def carry_forward(test_pairs: DataFrame, train_pairs: DataFrame) -> DataFrame:
    """Training class and percentile rank on test pairs; unseen pairs get class 0 and the mean rank."""
    carried = train_pairs.select(*PAIR, "export_trend_class", "export_trend_pct_rank")
    return (
        test_pairs.select(*PAIR, "rows")
        .join(carried, PAIR, "left")
        .withColumns(
            {
                "export_trend_class": F.coalesce("export_trend_class", F.lit(0)),
                "export_trend_pct_rank": F.coalesce(F.col("export_trend_pct_rank"), mean_rank(train_pairs)),
            }
        )
    )


def trend_carry_predictions(test_pairs: DataFrame, train_pairs: DataFrame) -> DataFrame:
    """Prediction of the test total by carrying the training step on; unseen pairs get 0."""
    halves = train_pairs.select(*PAIR, "export_period1", "export_period2")
    return (
        test_pairs.select(*PAIR)
        .join(halves, PAIR, "left")
        .select(*PAIR, carry_trend(F.col("export_period1"), F.col("export_period2")).alias("predictions"))
    )


def score(
    baseline: DataFrame,
    predictions: DataFrame,
    base: str = "period_total",
    train_years: int | None = None,
) -> DataFrame:
    """Baseline pairs with predictions and the predicted change.

    Models trained on single years predict a single year. ``period_total``
    measures them against the training total all the same; ``period_mean``
    divides that total by ``train_years`` first, for comparable units.
    """
    train = F.col("export_period_train")
    if base == "period_mean":
        if not train_years:
            raise ValueError("period_mean needs the number of training years")
        train = train / F.lit(float(train_years))
    elif base != "period_total":
        raise ValueError(f"unknown base {base!r}")
    return baseline.join(predictions.select(*PAIR, "predictions"), PAIR, "left").withColumn(
        "pred_pct_change", predicted_growth(F.col("predictions"), train)
    )


def rank_pairs(scored: DataFrame, level: str = "row") -> DataFrame:
    """Descending competition ranks of both changes and both totals; ``scored`` is a written table.

    ``row`` ranks panel rows, where a pair counts once per year; ``pair`` counts it once.
    """
    if level not in ("row", "pair"):
        raise ValueError(f"unknown level {level!r}")
    return global_rank(scored, RANKS, PAIR, weight="rows" if level == "row" else None)


def expand(pairs: DataFrame, panel_rows: DataFrame, spec: PeriodSpec | None = None) -> DataFrame:
    """Pair values on the panel's rows, one per year the pair appears in."""
    keys = panel_rows.select(*PAIR, "year")
    if spec is not None:
        keys = keys.filter(spec.covers(F.col("year")))
    return keys.join(pairs, PAIR)
