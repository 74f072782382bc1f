"""Cleaning, filtering and sampling of the (location, product, year) panel."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from growthlens.config import CELL, PeriodSpec, require
from growthlens.operators.aggregates import numeric_columns


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL and NaN become 0 in every numeric column."""
    return df.fillna(0, subset=numeric_columns(df))


def drop_negative_exports(panel: DataFrame) -> DataFrame:
    """Keep rows whose export is not negative; a missing export stays, negative imports stay."""
    return panel.filter(F.coalesce(F.col("export_value"), F.lit(0.0)) >= 0)


def clean_panel(panel: DataFrame) -> DataFrame:
    require(panel, [*CELL, "export_value", "import_value"])
    return drop_negative_exports(fill_zero(panel))


def filter_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose ``column`` is among ``values``; NULL never matches."""
    require(df, [column])
    if isinstance(values, range) and values.step == 1 and len(values):
        return df.filter(F.col(column).between(values.start, values.stop - 1))
    return df.filter(F.col(column).isin(list(values)))


def split_panel(panel: DataFrame, spec: PeriodSpec) -> DataFrame:
    return panel.filter(spec.covers(F.col("year")))


def cast_ids(df: DataFrame, columns: Iterable[str] = tuple(CELL)) -> DataFrame:
    """Ids and year as numbers, whatever the raw store holds; ids keep 64 bits."""
    return df.withColumns({c: F.col(c).cast("int" if c == "year" else "long") for c in columns})
