"""Names, schemas and period windows shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

PAIR = ["location_id", "product_id"]
CELL = [*PAIR, "year"]
LOCATION_YEAR = ["location_id", "year"]

# Ids are 64-bit: a product key of a large catalogue does not fit 32 bits.
PANEL_SCHEMA = T.StructType(
    [
        T.StructField("location_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("export_value", T.DoubleType()),
        T.StructField("import_value", T.DoubleType()),
    ]
)
LOCATION_SCHEMA = T.StructType(
    [T.StructField("index", T.LongType()), T.StructField("name_en", T.StringType())]
)
CLASS_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("level", T.StringType()),
    ]
)


@dataclass(frozen=True)
class PeriodSpec:
    """One split of the panel: years ``start..end-1``, cut in two halves at ``mid``."""

    start: int
    mid: int
    end: int

    def __post_init__(self):
        if not self.start < self.mid < self.end:
            raise ValueError(f"need start < mid < end, got {self}")

    @property
    def last_year(self) -> int:
        return self.end - 1

    def covers(self, year: Column) -> Column:
        return year.between(self.start, self.end - 1)

    def in_first_half(self, year: Column) -> Column:
        return year < self.mid

    def in_second_half(self, year: Column) -> Column:
        return year >= self.mid


@dataclass(frozen=True)
class Splits:
    """Training period and the later validation period."""

    train: PeriodSpec
    test: PeriodSpec

    def years(self) -> tuple[int, int]:
        """Half-open year range that covers both periods."""
        return min(self.train.start, self.test.start), max(self.train.end, self.test.end)


# The two decades, each split into five-year halves.
DECADES = Splits(PeriodSpec(1995, 2000, 2005), PeriodSpec(2005, 2010, 2015))


def require(df, columns) -> None:
    """Fail fast, by name, when a frame lacks a column it is about to need."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; frame has {df.columns}")


def col_names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def zero_if_null(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0.0))
