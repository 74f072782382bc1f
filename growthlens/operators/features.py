"""The feature table of one split, from the panel, in few passes.

Pair values (half sums, trend, its class and percentile rank) are computed on
the pair table, which is smaller than the panel by the number of years. All
scaling statistics come from one grouping of the rows by location and year;
location-wide and global moments are rolled up from that small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.config import LOCATION_YEAR, PAIR, PeriodSpec
from growthlens.functions.growth import sign_class
from growthlens.functions.scaling import minmax, share, standard
from growthlens.operators.aggregates import trend_table
from growthlens.operators.panel import fill_zero, split_panel
from growthlens.operators.ranking import global_rank
from growthlens.plans.attach import BROADCAST_ROWS, attach
from growthlens.plans.materialise import bucket_count, materialise, materialise_by

MOMENTS = ("min", "max", "mean", "std")
FEATURE_COLUMNS = [
    *PAIR,
    "year",
    "export_value",
    "export_total_loc_year",
    "export_period1",
    "export_period2",
    "export_period_total",
    "export_trend",
    "export_pct",
    "export_val_norm_all",
    "export_val_std_all",
    "export_pct_norm_all",
    "export_pct_std_all",
    "export_val_norm",
    "export_val_std",
    "export_pct_norm",
    "export_pct_std",
    "export_trend_norm",
    "export_trend_std",
    "export_trend_class",
    "export_trend_pct_rank",
]


@dataclass(frozen=True)
class Features:
    """Rows with every feature, the pair table behind them, and the group statistics."""

    rows: DataFrame
    pairs: DataFrame
    groups: DataFrame


def pair_features(panel: DataFrame, spec: PeriodSpec, colocate: bool = False, ranks: bool = True) -> DataFrame:
    """Trend table plus sign class and percentile rank, ranked over panel rows.

    Without ``ranks`` the percentile rank is NULL and costs nothing.
    """
    pairs = trend_table(panel, spec)
    if ranks or colocate:
        pairs = materialise(pairs, "pairs")
    if ranks:
        ranked = global_rank(
            pairs,
            {"export_trend": "export_trend_pct_rank"},
            PAIR,
            method="average",
            ascending=True,
            pct=True,
            weight="rows",
        )
    else:
        ranked = pairs.withColumn("export_trend_pct_rank", F.lit(None).cast("double"))
    ranked = ranked.withColumn("export_trend_class", sign_class(F.col("export_trend")))
    if colocate:  # as many rows as pairs, which are counted already: no write in between
        return materialise_by(ranked, PAIR, "pair_features", bucket_count(pairs))
    return materialise(ranked, "pair_features")


def _group_statistics(rows: DataFrame) -> DataFrame:
    """One row per location and year. Totals use every row, moments the rows whose pair is kept."""
    value = F.when(F.col("kept"), F.col("export_value"))
    trend = F.col("export_trend")
    return rows.groupBy(*LOCATION_YEAR).agg(
        F.sum("export_value").alias("export_total_loc_year"),
        F.count(value).alias("n"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.avg(value).alias("value_mean"),
        F.stddev_samp(value).alias("value_std"),
        F.min(trend).alias("trend_min"),
        F.max(trend).alias("trend_max"),
        F.avg(trend).alias("trend_mean"),
        F.stddev_samp(trend).alias("trend_std"),
    )


def _pooled_std(n: Column, mean: Column, std: Column, pooled_mean: Column) -> Column:
    """Sample deviation of a union of groups, from each group's size, mean and deviation."""
    inside = F.coalesce(std, F.lit(0.0)) ** 2 * (n - 1)
    between = n * (mean - pooled_mean) ** 2
    size = F.sum(n)
    return F.when(size > 1, F.sqrt(F.sum(inside + between) / (size - 1)))


def _pooled_mean(n: Column, mean: Column) -> Column:
    return F.try_divide(F.sum(n * mean), F.sum(n))


def _roll_up_trend(groups: DataFrame) -> DataFrame:
    """Trend moments per location; a location has at most one group per year of the split."""
    n, mean = F.col("n"), F.col("trend_mean")
    centre = groups.groupBy("location_id").agg(_pooled_mean(n, mean).alias("centre"))
    return (
        groups.join(centre, "location_id")
        .groupBy("location_id")
        .agg(
            F.min("trend_min").alias("trend_min"),
            F.max("trend_max").alias("trend_max"),
            F.first("centre").alias("trend_mean"),
            _pooled_std(n, mean, F.col("trend_std"), F.col("centre")).alias("trend_std"),
        )
    )


def global_moments(groups: DataFrame) -> dict[str, Column]:
    """Moments of value and share over all kept rows: one row, fetched as constants.

    Within a location and year the share is the value over a constant, so its
    moments there are the value's over that constant. Groups without a total
    have no shares and drop out of the share statistics.
    """
    total = F.col("export_total_loc_year")
    base = groups.select(
        F.col("n").alias("value_n"),
        *[F.col(f"value_{m}") for m in MOMENTS],
        F.when(total != 0, F.col("n")).alias("share_n"),
        *[share(F.col(f"value_{m}"), total).alias(f"share_{m}") for m in MOMENTS],
    )
    centres = base.agg(
        *[_pooled_mean(F.col(f"{k}_n"), F.col(f"{k}_mean")).alias(k) for k in ("value", "share")]
    ).first()
    out = []
    for k in ("value", "share"):
        n, mean, std = (F.col(f"{k}_{m}") for m in ("n", "mean", "std"))
        centre = F.lit(centres[k]).cast("double")
        out += [
            F.min(f"{k}_min").alias(f"{k}_min"),
            F.max(f"{k}_max").alias(f"{k}_max"),
            centre.alias(f"{k}_mean"),
            _pooled_std(n, mean, std, centre).alias(f"{k}_std"),
        ]
    found = base.agg(*out).first().asDict()
    return {name: F.lit(value).cast("double") for name, value in found.items()}


def build_features(
    panel: DataFrame,
    spec: PeriodSpec,
    broadcast_rows: int = BROADCAST_ROWS,
    colocate: bool = False,
    ranks: bool = True,
) -> Features:
    """Features of one split. ``panel`` is clean and should be a written table.

    ``colocate`` buckets the pair table by pair. With a panel bucketed alike,
    neither the half sums nor the join of pairs and rows shuffle the panel. Without
    ``ranks`` the percentile rank of the trend is left at 0, for callers that do not read it.
    """
    pairs = pair_features(panel, spec, colocate, ranks)
    rows = (
        split_panel(panel, spec)
        .select(*PAIR, "year", "export_value")
        .join(
            pairs.select(
                *PAIR,
                "export_period1",
                "export_period2",
                "export_period_total",
                "export_trend",
                "export_trend_class",
                "export_trend_pct_rank",
            ),
            PAIR,
            "left",
        )
        # Rows without a first half stay until the location-year totals are taken.
        .withColumn("kept", F.col("export_period1").isNotNull())
    )
    rows = materialise(rows, "split_rows")
    groups = materialise(_group_statistics(rows), "groups")
    trend = _roll_up_trend(groups)
    lookup = groups.drop(*[f"trend_{m}" for m in MOMENTS]).join(trend, "location_id")
    attached = attach(
        rows.filter("kept").drop("kept"),
        lookup,
        LOCATION_YEAR,
        ["product_id"],
        "inner",
        broadcast_rows,
        lookup_rows=groups.count(),
    )

    value, total, trend = F.col("export_value"), F.col("export_total_loc_year"), F.col("export_trend")
    pct = share(value, total)
    everywhere = global_moments(groups)
    in_group = [F.col(f"value_{m}") for m in MOMENTS]
    in_group_pct = [share(m, total) for m in in_group]
    in_location = [F.col(f"trend_{m}") for m in MOMENTS]
    all_value = [everywhere[f"value_{m}"] for m in MOMENTS]
    all_pct = [everywhere[f"share_{m}"] for m in MOMENTS]
    scaled = {"export_pct": pct}
    for name, column, stats in (
        ("export_val_{}_all", value, all_value),
        ("export_pct_{}_all", pct, all_pct),
        ("export_val_{}", value, in_group),
        ("export_pct_{}", pct, in_group_pct),
        ("export_trend_{}", trend, in_location),
    ):
        scaled[name.format("norm")] = minmax(column, *stats[:2])
        scaled[name.format("std")] = standard(column, *stats)
    return Features(fill_zero(attached.withColumns(scaled).select(*FEATURE_COLUMNS)), pairs, groups)
