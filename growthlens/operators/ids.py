"""Consecutive numbers for the values of a key column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from growthlens.plans.materialise import materialise

RANGE_VALUES = 1_000_000  # distinct values that one task puts in order


@dataclass(frozen=True)
class Numbering:
    """Distinct values with their numbers, as a written table, and how many there are."""

    table: DataFrame
    size: int


def dense_ids(df: DataFrame, column: str, name: str, range_values: int = RANGE_VALUES) -> Numbering:
    """Number the distinct values of ``column`` from 0 in value order.

    Up to ``range_values`` values are ordered in one task. More are written in ranges, one file each. A value's number is its
    place within its file plus the values of the files before it; only the files,
    one row per ``range_values`` values, are ever ordered in one task.
    """
    values = materialise(df.select(column).filter(F.col(column).isNotNull()).distinct(), "ids")
    size = values.count()
    ranges = max(1, -(-size // range_values))
    if ranges == 1:
        place = F.row_number().over(Window.orderBy(column)) - 1
        return Numbering(materialise(values.select(column, place.cast("long").alias(name)), "numbering"), size)
    ordered = materialise(values.repartitionByRange(ranges, column), "id_ranges")
    placed = ordered.select(column, F.col("_metadata.file_path").alias("_file"))
    files = placed.groupBy("_file").agg(F.min(column).alias("_first"), F.count(F.lit(1)).alias("_values"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_below"))
    position = F.row_number().over(Window.partitionBy("_file").orderBy(column)) - 1
    numbered = placed.withColumn("_position", position).join(starts, "_file")
    numbered = numbered.select(column, (F.col("_below") + F.col("_position")).alias(name))
    return Numbering(materialise(numbered, "numbering"), size)
