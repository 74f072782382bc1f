"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from growthlens.plans.materialise import materialise

#: The characters of ``[\x20\x09-\x0D]``.
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BROADCAST_BYTES = 32 * 1024 * 1024  # most that an operator of this package broadcasts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(id_column: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def bounded_sample(rows: DataFrame, id_column: str, at_most: int, seed: str) -> DataFrame:
    """About ``at_most`` rows by a hash of their id, or all rows if there are fewer.

    The slice depends on the id only, so a task that runs again repeats it. Ids are
    hashed with a margin of four standard deviations below the bound, which keeps the
    sample within it whatever the size of the table.
    """
    total = rows.count()
    if total <= at_most:
        return rows
    wanted = max(1.0, at_most - 4 * at_most**0.5)
    slots = 1 << 40
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(slots))
    return rows.filter(slot < F.lit(int(slots * wanted / total)))


def attach_small(rows: DataFrame, lookup: DataFrame, keys: list[str], row_bytes: int, how: str = "left") -> DataFrame:
    """Join a written lookup table: broadcast if its counted size is within the bound, by shuffle beyond it.

    Adaptive execution splits the partitions of hot keys on the side of ``rows``.
    """
    if lookup.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(lookup), keys, how)
    return rows.join(lookup.hint("merge"), keys, how)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the cluster's shared folder.

    Spark deletes the shuffle files of this write as soon as it ends, so that a loop over
    written tables does not fill the executors' disks.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_SHUFFLES, "false")
    conf.set(_CLEAN_SHUFFLES, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(_CLEAN_SHUFFLES, before)
