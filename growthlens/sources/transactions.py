"""Build the panel from order lines: one scan, one grouping for both trade flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from growthlens.config import CELL
from growthlens.operators.ids import dense_ids
from growthlens.plans.attach import shuffle_partitions

# The columns read from each table. A stated schema spares a job per table that would infer it.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "nation": "n_nationkey int, n_name string",
    "events": "ts timestamp_ntz, user_id bigint, value double, props string",
}

HIGH = 1_000_000  # units per step of the high part of a split sum
FIRST_DAY = "2024-01-01"  # period 1 of an event panel
TASK_LINES = 400_000  # order lines that one task joins and groups, on average


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, folder, n) for n in names}


def whole_units(column: str, places: int) -> Column:
    """A number as a whole count of its last decimal place; a value with more places stops the run."""
    scaled = F.col(column) * F.lit(float(10**places))
    whole = F.rint(scaled)
    # A double nearest to a decimal is off by a few units in its last digit, not more.
    fits = F.abs(scaled - whole) <= F.greatest(F.abs(scaled), F.lit(1.0)) * 1e-9
    problem = F.concat(F.lit(f"{column} has more than {places} decimal places: "), F.col(column).cast("string"))
    return F.when(F.col(column).isNull() | fits, whole.cast("long")).otherwise(F.raise_error(problem).cast("long"))


def line_units(price_places: int = 2, discount_places: int = 2) -> Column:
    """Discounted price in whole units of the last place, so that sums do not depend on their order."""
    kept = F.lit(10**discount_places) - whole_units("l_discount", discount_places)
    return whole_units("l_extendedprice", price_places) * kept


def sum_of_units(units: str, units_per_amount: int) -> Column:
    """Exact sum of whole units as an amount.

    Summed as high and low part: two 64-bit sums stay in generated code, where a
    decimal sum would not, and neither can overflow at any realistic size.
    """
    high = F.sum(F.expr(f"{units} div {HIGH}")).cast("double")
    low = F.sum(F.col(units) % HIGH).cast("double")
    return (high * HIGH + low) / units_per_amount


def in_years(orders: DataFrame, years: tuple[int, int] | None) -> DataFrame:
    """Orders of the half-open year range, as a date range that reaches the Parquet scan."""
    if years is None:
        return orders
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in years)
    return orders.filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))


def product_lookup(part: DataFrame, product: str) -> DataFrame:
    """``l_partkey -> product_id``, numbering the names of a text column."""
    names = dense_ids(part, product, "product_id").table
    return part.select(F.col("p_partkey").alias("l_partkey"), product).join(names, product).drop(product)


def dealt(df: DataFrame, lines: int, keys: Sequence[str]) -> DataFrame:
    """``df`` by ``keys`` in tasks of ``TASK_LINES`` lines; as it is while the session's cores are as many.

    More shuffle partitions than cores are no bound: adaptive execution merges them by their compressed bytes.
    """
    spark = df.sparkSession
    tasks = -(-lines // TASK_LINES)
    least = min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys) if tasks > least else df


def build_panel(
    tables: dict[str, DataFrame],
    product: str = "p_partkey",
    years: tuple[int, int] | None = None,
    price_places: int = 2,
    discount_places: int = 2,
) -> DataFrame:
    """``(location, product, year, export, import)`` from order lines.

    Prices and discounts hold at most the given decimal places; a finer value stops the run.

    A line is an export of the supplier's nation and an import of the
    customer's. Each line yields both records and one grouping sums them: no
    second pass over the lines and no outer join. A flow without lines stays
    NULL. Joins carry no hints; the size of suppliers, customers and parts
    grows with the data, so the choice is left to run-time statistics. The number of
    tasks that join and group lines follows from the lines, so none of them holds more
    cells as the data grows.
    """
    count = tables["lineitem"].count()  # answered by the Parquet footers
    customers = tables["customer"].select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("importer")
    )
    orders = (
        in_years(tables["orders"], years)
        .select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year")
        )
        .join(customers, "o_custkey")
        .drop("o_custkey")
    )
    suppliers = tables["supplier"].select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("exporter")
    )
    lines = tables["lineitem"].join(suppliers, "l_suppkey")
    if product == "p_partkey":
        lines = lines.withColumn("product_id", F.col("l_partkey").cast("long"))
    else:
        lines = lines.join(product_lookup(tables["part"], product), "l_partkey")
    lines = lines.select("l_orderkey", "product_id", "exporter", line_units(price_places, discount_places).alias("units"))
    none = F.lit(None).cast("long")
    unit = 10 ** (price_places + discount_places)
    flows = F.explode(
        F.array(
            F.struct(
                F.col("exporter").alias("location_id"), F.col("units").alias("export"), none.alias("import")
            ),
            F.struct(
                F.col("importer").alias("location_id"), none.alias("export"), F.col("units").alias("import")
            ),
        )
    )
    joined = dealt(lines, count, ["l_orderkey"]).join(dealt(orders, count, ["l_orderkey"]), "l_orderkey")
    cells = joined.select("product_id", "year", flows.alias("flow")).select("flow.*", "product_id", "year")
    if product == "p_partkey":  # nearly a cell per line; the few of a coarse product are combined before the shuffle
        cells = dealt(cells, count, CELL)
    return (
        cells.groupBy(*CELL)
        .agg(sum_of_units("export", unit).alias("export_value"), sum_of_units("import", unit).alias("import_value"))
    )


def trade_panel(
    spark: SparkSession, folder: str, product: str = "p_partkey", years: tuple[int, int] | None = None
) -> DataFrame:
    names = ["lineitem", "orders", "supplier", "customer"] + ([] if product == "p_partkey" else ["part"])
    return build_panel(read_tables(spark, folder, names), product, years)


def nations_as_locations(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("name_en"))


def fine_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as the fine classes."""
    part = read_table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").cast("long").alias("index"), F.col("p_name").alias("name"), F.lit("6digit").alias("level")
    )


def parts_as_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Fine classes are parts; coarse classes are brands, numbered in name order."""
    brands = dense_ids(read_table(spark, folder, "part"), "p_brand", "index")
    coarse = brands.table.select("index", F.col("p_brand").alias("name"), F.lit("2digit").alias("level"))
    return fine_classes(spark, folder).unionByName(coarse)


def events_as_panel(events: DataFrame, first_day: str = FIRST_DAY, value_places: int = 2) -> DataFrame:
    """Users as locations, the event key as product, days counted from ``first_day`` (1) as periods."""
    key = F.get_json_object("props", "$.k").cast("long")
    day = F.datediff(F.col("ts").cast("date"), F.lit(first_day).cast("date")) + 1
    return (
        events.select(
            F.col("user_id").alias("location_id"),
            key.alias("product_id"),
            day.alias("year"),
            whole_units("value", value_places).alias("units"),
        )
        .groupBy("location_id", "product_id", "year")
        .agg(sum_of_units("units", 10**value_places).alias("export_value"))
        .withColumn("import_value", F.lit(None).cast("double"))
    )


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Another panel of the same shape, from the event table."""
    return events_as_panel(read_table(spark, folder, "events"))
