"""Grouped sums, half-period sums with their trend, null and cardinality checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from growthlens.config import LOCATION_YEAR, PAIR, PeriodSpec, col_names, require, zero_if_null
from growthlens.functions.growth import trend_growth


def group_sum(df: DataFrame, groups: Sequence[str], targets: dict[str, str]) -> DataFrame:
    """Sum each ``{column: output name}`` per group."""
    groups = col_names(groups)
    require(df, [*groups, *targets])
    return df.groupBy(*groups).agg(*[F.sum(c).alias(name) for c, name in targets.items()])


def location_year_totals(panel: DataFrame) -> DataFrame:
    return group_sum(
        panel,
        LOCATION_YEAR,
        {"export_value": "export_total_loc_year", "import_value": "import_total_loc_year"},
    )


def period_sums(panel: DataFrame, spec: PeriodSpec) -> DataFrame:
    """Both half sums and the total of every pair, in one grouping.

    A half without any row is NULL, not zero; ``rows1`` and ``rows`` count the
    rows of the first half and of the whole period. A pair's few yearly values, each
    in a sum of its own, are added from the first year on, so that equal pairs have equal
    sums in every run and trends tie or differ for good. Plain sums combine in generated
    code; lists of a pair's rows would be sorted and built row by row.
    """
    years, year = range(spec.start, spec.end), F.col("year")
    halves = {
        "period1": [y for y in years if y < spec.mid],
        "period2": [y for y in years if y >= spec.mid],
        "period_total": years,
    }
    flows = ("export", "import")
    yearly = [F.sum(F.when(year == y, F.col(f"{flow}_value"))).alias(f"_{flow}_{y}") for flow in flows for y in years]
    pairs = panel.filter(spec.covers(year)).groupBy(*PAIR).agg(
        *yearly, F.count_if(spec.in_first_half(year)).alias("rows1"), F.count(F.lit(1)).alias("rows")
    )

    def total(flow: str, inside: Sequence[int]) -> Column:
        values = [F.col(f"_{flow}_{y}") for y in inside]
        added = reduce(lambda a, c: a + zero_if_null(c), values, F.lit(0.0))
        return F.when(reduce(lambda a, c: a | c.isNotNull(), values, F.lit(False)), added)

    sums = [total(flow, inside).alias(f"{flow}_{part}") for flow in flows for part, inside in halves.items()]
    return pairs.select(*PAIR, *sums, "rows1", "rows")


def trend_table(panel: DataFrame, spec: PeriodSpec) -> DataFrame:
    """Half sums, totals and half-over-half growth of every pair seen in the first half."""
    return trends_of(period_sums(panel, spec))


def trends_of(sums: DataFrame) -> DataFrame:
    """The trend table that follows from period sums."""
    sums = sums.filter(F.col("rows1") > 0)
    out = []
    for flow in ("export", "import"):
        first, second = F.col(f"{flow}_period1"), F.col(f"{flow}_period2")
        out += [
            first,
            zero_if_null(second).alias(f"{flow}_period2"),
            trend_growth(second, first).alias(f"{flow}_trend"),
            F.col(f"{flow}_period_total"),
        ]
    return sums.select(*PAIR, *out, "rows")


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and NULLs per column, one row per column, from a single pass."""
    names = col_names(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    entry = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in names]
    return counts.select("rows", F.explode(F.array(*entry)).alias("e")).select(
        "e.column", "rows", "e.nulls", (F.col("e.nulls") > 0).alias("has_nulls")
    )


def key_cardinality(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Largest value and number of distinct values per numeric column; NULL counts as a value.

    The exact form merges distinct values map-side and counts them in parallel.
    ``approximate`` takes one sketch per column instead, in a single pass.
    """
    columns = col_names(columns)
    largest = [F.max(c).cast("double").alias(f"max_{c}") for c in columns]
    if approximate:
        has_null = {c: F.max(F.col(c).isNull().cast("int")) for c in columns}
        counts = [(F.approx_count_distinct(c) + has_null[c]).alias(f"n_{c}") for c in columns]
        return _per_column(df.agg(*largest, *counts), columns, max_value="max_", distinct_values="n_")
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    counts = (
        df.select(cells.alias("e"))
        .select("e.*")
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
    )
    return _per_column(df.agg(*largest), columns, max_value="max_").join(counts, "column")


def _per_column(row: DataFrame, columns: Sequence[str], **prefixes: str) -> DataFrame:
    """One row of per-column aggregates as one row per column."""
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{c}").alias(name) for name, p in prefixes.items()])
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def struct_scalar(df: DataFrame, **aggregates: Column) -> Column:
    """Several one-row aggregates of ``df`` as one scalar subquery; use ``.getField``."""
    return df.agg(F.struct(*[c.alias(name) for name, c in aggregates.items()]).alias("s")).scalar()
