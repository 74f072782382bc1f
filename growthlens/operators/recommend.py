"""Top recommendations for one location or for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from growthlens.config import require
from growthlens.plans.attach import shuffle_partitions, slice_of
from growthlens.plans.materialise import materialise

DISPLAY_COLUMNS = [
    "position",
    "product_id",
    "name",
    "export_period_test",
    "export_pct_change",
    "export_pct_change_rank_loc",
    "predictions",
    "pred_pct_change",
]


def location_id_of(locations: DataFrame, name: str) -> int:
    """The id of the one location called ``name``."""
    found = locations.filter(F.col("name_en") == name).select("index").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} location is called {name!r}")
    return found[0]["index"]


def classes_of_level(classes: DataFrame, level: str) -> DataFrame:
    return classes.filter(F.col("level") == level)


def with_names(recommended: DataFrame, classes: DataFrame) -> DataFrame:
    """Add product names; the rows keep their ``position``.

    The recommended rows are few and written first. The catalogue, which may be
    large, is cut to their products before the outer join.
    """
    recommended = materialise(recommended, "recommended")
    names = classes.select(F.col("index").alias("product_id"), "name")
    wanted = recommended.select("product_id").distinct()
    return recommended.join(names.join(wanted, "product_id", "left_semi"), "product_id", "left")


def _best(score: str) -> list[Column]:
    return [F.desc(score), F.asc("product_id")]


def top_n(
    scored: DataFrame,
    location: int,
    year: int,
    n: int = 50,
    score: str = "pred_pct_change",
    new_goods_only: bool = False,
) -> DataFrame:
    """The ``n`` best rows of a location and year, with their ``position``; equal scores go by product id."""
    require(scored, ["location_id", "year", score])
    rows = scored.filter((F.col("location_id") == location) & (F.col("year") == year))
    if new_goods_only:
        rows = rows.filter(F.col("export_period_train") == 0)
    best = rows.orderBy(*_best(score)).limit(n)
    position = F.row_number().over(Window.partitionBy("location_id").orderBy(*_best(score)))
    return best.withColumn("position", position)


def in_order(recommended: DataFrame) -> DataFrame:
    """Recommendations of one location, few rows, from the best down."""
    return recommended.orderBy("position")


def top_n_all(scored: DataFrame, year: int, n: int = 50, score: str = "pred_pct_change") -> DataFrame:
    """The ``n`` best products of every location, with their ``position``.

    A location's rows are first cut to ``n`` per slice of its products, so that what
    the tasks before have left of a large location meets in several tasks, and then to
    ``n`` once more. Either limit is applied before its shuffle as well.
    """
    rows = scored.filter(F.col("year") == year)
    slices = shuffle_partitions(scored.sparkSession)
    rows = rows.withColumn("_slice", slice_of(["product_id"], F.lit(slices)))
    in_slice = Window.partitionBy("location_id", "_slice").orderBy(*_best(score))
    rows = rows.withColumn("position", F.row_number().over(in_slice)).filter(F.col("position") <= n)
    ordered = Window.partitionBy("location_id").orderBy(*_best(score))
    return rows.drop("_slice").withColumn("position", F.row_number().over(ordered)).filter(F.col("position") <= n)


def rank_within(top: DataFrame, inverted: bool = False) -> DataFrame:
    """Rank of the actual change among the recommended rows of a location.

    By default 1 is the highest actual growth. ``inverted`` ranks the descending
    rank once more in descending order, which makes 1 the lowest.
    """
    position = F.col("export_pct_change_rank")
    ordered = Window.partitionBy("location_id").orderBy(position.desc() if inverted else position.asc())
    return top.withColumn("export_pct_change_rank_loc", F.rank().over(ordered))
