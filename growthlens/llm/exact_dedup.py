"""Exact deduplication: 128-bit content hash, smallest stable id, bytes compared inside groups.

Only ids, hashes and lengths are shuffled for the groups. To exclude collisions
the texts of repeated hashes are read again, copies within a task collapse to one
text first, and the distinct texts of each hash are counted. A hash with several
texts is cut into its texts, so equal groups hold equal bytes whatever the hash.

Defined results: a null text counts as empty, and all empty texts are copies of
each other. Of equal texts the row with most code points in the original text
stays, then the one with the smallest id; a null id comes last. Of rows that
repeat the kept one's id and length one is kept. An empty table gives an empty table. Columns other
than id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from growthlens.llm.common import WHITE_SPACE, attach_small, whole_text, written

REPEATS = 10_000  # numbers of repeats that one step lists
HOT_GROUPS = 1_000  # fewer groups than this can each hold more than a thousandth of the rows


def normalised(text: str = "text") -> Column:
    """The text without its white space."""
    out = whole_text(text)
    for character in WHITE_SPACE:
        out = F.replace(out, F.lit(character), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(norm))


def _hashed(docs: DataFrame, id_column: str, text: str, hashed: Callable[[Column], Column]) -> DataFrame:
    return (
        docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
        .select("_id", F.char_length(whole_text("_text")).cast("long").alias("_length"), normalised("_text").alias("_norm"))
        .withColumn("_hash", hashed(F.col("_norm")))
    )


def _split_collisions(rows: DataFrame, texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Give the rows of a hash that several texts share the number of their text, by bytes."""
    inside = attach_small(texts, repeated, ["_hash"], 64, "left_semi")
    variants = written(inside.select("_hash", "_norm").distinct(), "variants")
    several = written(variants.groupBy("_hash").count().filter("count > 1").select("_hash"), "collisions")
    if several.isEmpty():
        return rows
    numbered = (
        variants.join(several, "_hash", "left_semi")
        .withColumn("_part", F.row_number().over(Window.partitionBy("_hash").orderBy("_norm")))
        .select("_hash", "_norm", "_part")
    )
    parted = attach_small(texts, several, ["_hash"], 64, "left_semi").join(numbered, ["_hash", "_norm"])
    parted = parted.select("_id", "_length", "_hash", F.sha2("_norm", 256).alias("_sha"), "_part")
    return written(rows.join(several, "_hash", "left_anti").unionByName(parted), "rows")


def grouped(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> tuple[DataFrame, DataFrame]:
    """Rows ``(_id, _length, _hash, _sha, _part)`` and groups ``(_hash, _part, _sha, group_size, keep_id, keep_length, keepers)``."""
    texts = _hashed(docs, id_column, text, hashed)
    rows = written(
        texts.select("_id", "_length", "_hash", F.sha2("_norm", 256).alias("_sha"), F.lit(0).alias("_part")), "rows"
    )
    repeated = written(rows.groupBy("_hash").count().filter("count > 1").select("_hash"), "repeated")
    rows = _split_collisions(rows, texts, repeated)
    groups = (
        rows.groupBy("_hash", "_part", "_sha", "_id", "_length")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_rank", F.struct((-F.col("_length")).alias("l"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_n").alias("n")))
        .groupBy("_hash", "_part")
        .agg(F.sum("_n").alias("group_size"), F.min("_rank").alias("_best"), F.min("_sha").alias("_sha"))
        .select(
            "_hash", "_part", "_sha", "group_size",
            F.col("_best.i").alias("keep_id"), (-F.col("_best.l")).alias("keep_length"), F.col("_best.n").alias("keepers"),
        )
    )
    return rows, written(groups, "groups")


def _with_group(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Join rows to their group; the few groups that may be hot never meet in one task.

    Fewer than ``HOT_GROUPS`` groups can hold more than their share of the rows: those
    are broadcast, the others joined by shuffle.
    """
    is_hot = F.col("group_size") * HOT_GROUPS > F.lit(total)
    hot = F.broadcast(groups.filter(is_hot).drop("_sha"))
    groups = groups.drop("_sha")
    keys = ["_hash", "_part"]
    return (
        rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(~is_hot), keys))
    )


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows, groups = grouped(docs, id_column, text, hashed)
    best = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("keep_length"))
    members = _with_group(rows, groups, rows.count()).withColumn("kept", best)
    columns = [F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256")]
    single = members.filter("not kept or keepers = 1").select(*columns)
    # Rows that repeat the kept one in id and length look alike: they are counted, and the first of them stays.
    repeats = groups.filter("keepers > 1").select("keep_id", "group_size", "_sha", F.explode(_numbers(F.col("keepers"))).alias("_block"))
    repeats = repeats.withColumn("_number", F.explode(F.sequence("_block.first", "_block.last")))
    again = repeats.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("_number") == 1).alias("kept"), F.col("_sha").alias("text_sha256"))
    return single.unionByName(again)


def _numbers(n: Column) -> Column:
    """The numbers from 1 to ``n`` as blocks ``first, last`` of bounded length."""
    starts = F.sequence(F.lit(1).cast("long"), n.cast("long"), F.lit(REPEATS).cast("long"))
    return F.transform(starts, lambda i: F.struct(i.alias("first"), F.least(i + REPEATS - 1, n).alias("last")))


def keep_first_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeats of one row leave one.

    Only groups of more than one row are looked up, by content hash and digest, so the
    texts are shuffled only if those groups are too many to be broadcast.
    """
    _, groups = grouped(docs, id_column, text)
    repeated = groups.filter("group_size > 1").select(
        "_hash", "_sha", F.col("keep_id").alias("_keep_id"), F.col("keep_length").alias("_keep_length"), F.col("keepers").alias("_keepers")
    )
    repeated = written(repeated, "repeated_groups")
    norm = normalised(text)
    looked_up = attach_small(
        docs.withColumns({"_hash": content_hash(norm), "_sha": F.sha2(norm, 256)}), repeated, ["_hash", "_sha"], 160
    )
    first = F.col(id_column).eqNullSafe(F.col("_keep_id")) & (F.char_length(whole_text(text)) == F.col("_keep_length"))
    stays = looked_up.filter(F.col("_keepers").isNull() | first)
    once = stays.filter("_keepers is null or _keepers = 1").select(*docs.columns)
    if repeated.filter("_keepers > 1").isEmpty():
        return once
    again = stays.filter("_keepers > 1").dropDuplicates(["_hash", "_sha"]).select(*docs.columns)
    return once.unionByName(again)
