"""Quantiles of tables that grow by parts, from sketches that are kept beside them.

One KLL sketch per part (a year, a load) and column is stored with the number of values and
the extremes. Sketches of parts merge into sketches of their union, tasks merging theirs
before the shuffle, so a profile of all parts reads some kilobytes per part and no rows.
``exact_quantiles`` is the exact form, which sorts.

A sketch of parameter ``k`` gives a value whose rank is off by at most ``rank_error(k)`` of the
rows with 99 % confidence, however many parts were merged. Null and NaN are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.config import col_names, require

ACCURACY = 1_000  # k of a sketch: some 15 kB each, ranks within 0.3 %


def rank_error(k: int = ACCURACY) -> float:
    """The published error of a KLL sketch's single ranks, as a share of all rows, at 99 % confidence."""
    return 2.296 / k**0.9723


def _value(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def column_sketches(df: DataFrame, columns: Sequence[str], parts: Sequence[str] = (), k: int = ACCURACY) -> DataFrame:
    """``parts, column, n, low, high, sketch`` per part and column, in one pass; a column without values has no row."""
    columns, parts = col_names(columns), col_names(parts)
    require(df, [*columns, *parts])
    aggregates = []
    for i, c in enumerate(columns):
        v = F.col(f"_{i}")
        aggregates += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.kll_sketch_agg_double(v, k).alias(f"sketch{i}")]
    grouped = df.select(*parts, *[_value(c).alias(f"_{i}") for i, c in enumerate(columns)]).groupBy(*parts).agg(*aggregates)
    entry = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in ("n", "low", "high", "sketch")])
            for i, c in enumerate(columns)
        ]
    )
    return grouped.select(*parts, F.explode(entry).alias("_e")).select(*parts, "_e.*").filter("n > 0")


def merged_sketches(sketches: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Sketches of unions: one per column and value of ``parts``, of all the other parts together."""
    parts = col_names(parts)
    return sketches.groupBy(*parts, "column").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """One row per sketch and probability with the ``value`` there; 0 and 1 give the exact extremes."""
    others = [c for c in sketches.columns if c not in ("n", "low", "high", "sketch")]
    values = []
    for p in probabilities:
        found = F.col("low") if p <= 0 else F.col("high") if p >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
        values.append(F.struct(F.lit(float(p)).alias("probability"), found.cast("double").alias("value")))
    return sketches.select(*others, "n", F.explode(F.array(*values)).alias("_e")).select(*others, "n", "_e.*")


def true_ranks(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``quantiles`` of whole columns with ``off``, how far their true rank in ``df`` lies from the probability, as a share of rows."""
    wanted = quantiles.select("column", "probability", "value").collect()  # columns times probabilities
    counts = []
    for i, w in enumerate(wanted):
        v = _value(w["column"])
        counts += [F.count_if(v < w["value"]).alias(f"below{i}"), F.count_if(v <= w["value"]).alias(f"upto{i}"), F.count(v).alias(f"n{i}")]
    row = df.agg(*counts).first()
    found = []
    for i, w in enumerate(wanted):
        p, n = w["probability"], max(row[f"n{i}"], 1)
        found.append((w["column"], p, max(row[f"below{i}"] / n - p, p - row[f"upto{i}"] / n, 0.0)))
    off = df.sparkSession.createDataFrame(found, "column string, probability double, off double")
    return quantiles.join(F.broadcast(off), ["column", "probability"])
