"""Join a lookup table onto rows without trusting the key distribution.

The lookup holds one row per key. It is broadcast only after its size has been
checked. Beyond the bound the join shuffles, and the most frequent keys are
spread over many partitions, so that one key with a third of all rows does not
end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from growthlens.plans.materialise import materialise

BROADCAST_ROWS = 200_000  # rows of a lookup that may be broadcast
BROADCAST_BYTES = 64 * 1024 * 1024  # and their size


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    lookup_rows: int | None = None,
) -> DataFrame:
    """``rows`` joined with ``lookup`` on ``keys`` (``left`` or ``inner``).

    ``spread_by`` names columns that differ between rows of one key; they decide
    the slice of a hot key's rows, and always decide the same. ``lookup_rows`` is
    the size of the lookup, or more, where that is known; otherwise the lookup is
    written here so that it can be counted.
    """
    if lookup_rows is None:
        lookup = materialise(lookup, "lookup")
        lookup_rows = lookup.count()  # answered by the Parquet footers
    if lookup_rows <= broadcast_rows and lookup_rows * row_bytes(lookup) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(lookup), list(keys), how)
    return spread_join(materialise(rows, "rows"), lookup, keys, spread_by, how)


def row_bytes(table: DataFrame) -> float:
    """Bytes of a row of a written table: 8 per number, what they hold on average for texts and arrays."""
    fixed, parts = 0, []
    for field in table.schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.avg(F.octet_length(column)))
        elif isinstance(kind, T.ArrayType):
            parts.append(F.avg(F.size(column)) * 8)
        fixed += 8
    if not parts:
        return fixed
    return fixed + sum(x or 0 for x in table.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).first())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slice_of(spread_by: Sequence[str], slices: Column) -> Column:
    """A slice number that depends on the row's own columns only, so a re-run task repeats it."""
    return F.pmod(F.xxhash64(*spread_by), slices).cast("int")


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Written table of the keys that hold more than one partition's share of ``rows``, with their number of slices.

    With P shuffle partitions fewer than P keys can exceed ``1/P`` of the rows, and they get
    fewer than 2 P slices together.
    """
    keys = list(keys)
    share = F.col("_n") * F.lit(shuffle_partitions(rows.sparkSession)) / F.lit(max(rows.count(), 1))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(share > 1)
    return materialise(counted.select(*keys, F.ceil(share).cast("int").alias("_slices")), "hot_keys")


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which a key with more than one partition's share of rows is sliced.

    ``rows`` is read three times and should be a written table, or once if its ``hot_keys`` are
    given. Their bound also bounds what is broadcast here and how often lookup rows are repeated.
    """
    keys = list(keys)
    partitions = shuffle_partitions(rows.sparkSession)
    hot = hot_keys(rows, keys) if hot is None else hot
    slices = F.coalesce(F.col("_slices"), F.lit(1))

    # Rows without a key match nothing, however many there are: spread them too.
    no_key = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", slice_of(spread_by, F.when(no_key, partitions).otherwise(slices))
    )
    right = lookup.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    joined = left.drop("_slices").join(right.drop("_slices"), [*keys, "_slice"], how)
    return joined.drop("_slice")
