"""Trends and moments of a growing period, refreshed by appended years instead of the whole panel.

What is kept per split can be merged: sums and row counts per pair, and size, mean,
deviation, minimum and maximum per location and year. A later year adds to the sums of the pairs it
holds and brings groups of its own; nothing else changes, since a pair belongs to the split
by its rows of the first half, and a row of an earlier year that belongs now did so before. So
a refresh reads the new year's rows and the kept tables, never the old years.

Yearly values enter a pair's sums from the first year on, as in a full run, so both
give the same numbers to the last bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.config import LOCATION_YEAR, PAIR, PeriodSpec
from growthlens.operators.aggregates import period_sums, trends_of
from growthlens.sources.catalog import TableCatalog

SUMS = [f"{flow}_{part}" for flow in ("export", "import") for part in ("period1", "period2", "period_total")]
COUNTS = ["rows1", "rows"]


@dataclass(frozen=True)
class PeriodState:
    """Sums per pair, value moments per location and year, and the years that are in them."""

    sums: DataFrame
    groups: DataFrame
    spec: PeriodSpec
    last_year: int | None


def _groups(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Totals over all rows and moments over those whose pair is in the split, by location and year."""
    kept = sums.select(*PAIR, (F.col("rows1") > 0).alias("kept"))
    value = F.when(F.col("kept"), F.col("export_value"))
    return rows.join(kept, PAIR, "left").groupBy(*LOCATION_YEAR).agg(
        F.sum("export_value").alias("export_total_loc_year"),
        F.count(value).alias("n"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.avg(value).alias("value_mean"),
        F.stddev_samp(value).alias("value_std"),
    )


def _last_year(rows: DataFrame) -> int | None:
    return rows.agg(F.max("year")).first()[0]


def period_state(panel: DataFrame, spec: PeriodSpec) -> PeriodState:
    """The state of a split from the years there are; ``panel`` should be a written table."""
    rows = panel.filter(spec.covers(F.col("year")))
    sums = period_sums(rows, spec)
    return PeriodState(sums, _groups(rows, sums), spec, _last_year(rows))


def _added(a: str, b: str) -> Column:
    """The sum of two columns, of which either may be missing."""
    return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col(b))


def appended(state: PeriodState, rows: DataFrame) -> PeriodState:
    """The state with the rows of one later year; they should be a written table.

    Several new years are appended one after another, as a full run would add them. Pairs that the
    new year does not hold keep their row of the state as it is.
    """
    rows = rows.filter(state.spec.covers(F.col("year")))
    years = rows.agg(F.min("year"), F.max("year")).first()
    if years[0] is None:
        return state
    if years[0] != years[1] or (state.last_year is not None and years[0] <= state.last_year):
        raise ValueError(f"need one year after {state.last_year}, got {years[0]} to {years[1]}")
    new = period_sums(rows, state.spec)
    old = state.sums.withColumnsRenamed({c: f"_old_{c}" for c in (*SUMS, *COUNTS)})
    merged = old.join(new, PAIR, "full").select(
        *PAIR,
        *[_added(f"_old_{c}", c).alias(c) for c in SUMS],
        *[(F.coalesce(f"_old_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS],
    )
    here = merged.join(new.select(*PAIR), PAIR, "left_semi")
    return PeriodState(merged, state.groups.unionByName(_groups(rows, here)), state.spec, years[0])


def state_trends(state: PeriodState) -> DataFrame:
    """The trend table of the split so far."""
    return trends_of(state.sums)


def save_state(catalog: TableCatalog, name: str, state: PeriodState) -> PeriodState:
    """Publish both tables of a state together, and return it as read back."""
    spark, spec = catalog.spark, state.spec
    years = spark.createDataFrame([(spec.start, spec.mid, spec.end, state.last_year)], "start int, mid int, end int, last_year int")
    catalog.write_all({f"{name}/sums": state.sums, f"{name}/groups": state.groups, f"{name}/years": years})
    return load_state(catalog, name)


def load_state(catalog: TableCatalog, name: str) -> PeriodState:
    catalog = catalog.pinned()
    years = catalog.read(f"{name}/years").first()
    spec = PeriodSpec(years["start"], years["mid"], years["end"])
    return PeriodState(catalog.read(f"{name}/sums"), catalog.read(f"{name}/groups"), spec, years["last_year"])


def refresh_year(catalog: TableCatalog, panel_key: str, name: str, year: int) -> PeriodState:
    """Append one year of a panel that is stored by year to a stored state; the other years' files are not read."""
    rows = catalog.read(panel_key).filter(F.col("year") == year)
    return save_state(catalog, name, appended(load_state(catalog, name), rows))
