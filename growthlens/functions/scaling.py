"""Column expressions for min-max and standard scaling, and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def minmax(value: Column, low: Column, high: Column) -> Column:
    """0..1 within the range; 0 for an empty or constant range."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def standard(value: Column, low: Column, high: Column, mean: Column, std: Column) -> Column:
    """Standard score with the sample deviation; 0 for a constant or single-row group.

    The range is tested first because the deviation of a constant group can
    come out as a tiny non-zero number.
    """
    return F.when((high > low) & (std > 0), (value - mean) / std).otherwise(0.0)


def unminmax(value: Column, low: Column, high: Column) -> Column:
    return value * (high - low) + low


def destandardise(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def share(part: Column, total: Column) -> Column:
    """Part of the total; NULL when the total is zero, so that statistics skip it."""
    return F.when(total != 0, part / total)
