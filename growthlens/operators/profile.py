"""Column profile: count, mean, deviation, minimum, quartiles, maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from growthlens.config import col_names
from growthlens.operators.aggregates import numeric_columns
from growthlens.operators.ranking import exact_quantiles

QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column. Quartiles are exact and interpolated; ``df`` should be a written table."""
    columns = col_names(columns or numeric_columns(df))
    stats = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    row = df.agg(*[f(c).cast("double").alias(f"{c}:{s}") for c in columns for s, f in stats.items()])
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}:{s}`").alias(s) for s in stats]) for c in columns
    ]
    moments = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    quartiles = (
        exact_quantiles(df, columns, list(QUARTILES.values()))
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name) for name, p in QUARTILES.items()])
    )
    return moments.join(quartiles, "column").select(
        "column", F.col("count").cast("long").alias("count"), "mean", "std", "min", *QUARTILES, "max"
    )
