"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are computed per text, copies of a fingerprint collapse, and the
distinct ones are linked where they differ in few bits:

* Buckets. With at most ``d`` differing bits, two fingerprints agree on one of
  ``d + 1`` blocks of bits. Each fingerprint goes to one bucket per block. A bucket
  that holds more than ``BUCKET_ROWS`` fingerprints is cut again the same way on its
  remaining bits, so a hot block ends in many tasks and no pair is lost.
* Index. A task sorts the fingerprints of its buckets by Gray rank. Neighbours in
  that order share masked bit patterns; these are factored into nodes (mask of the
  agreed bits, their values), and nodes into upper nodes. The search descends pairs
  of nodes; bits that differ on what both nodes agree on accumulate downwards, and
  once they exceed ``d`` the two whole groups are pruned.
* Links are joined inside the task, so a task gives at most one edge per fingerprint
  and never the pairs of a group. Components are found by large-star and small-star
  joins over written tables.

Defined results: a null or blank text has fingerprint zero, linked like any other.
Fewer words than a shingle make one shingle. Rows that repeat an id are separate
rows. A null id never names a component unless all its ids are null. An empty
table gives an empty table. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from growthlens.llm.common import attach_small, written
from growthlens.llm.components import components
from growthlens.plans.attach import attach

SEED = 42
ROWS_PER_TASK = 400_000  # bucket rows that one task indexes
BUCKET_ROWS = 8_192  # fingerprints of one bucket before it is cut again
LEAF, FAN = 16, 8  # fingerprints in a leaf node, nodes below an upper node
SLICE = 1 << 18  # node pairs that a task holds at once
_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint_of(text: str | None, words_per_shingle: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - words_per_shingle]]
    stops = ends[words_per_shingle - 1 :]
    total, digest, view = np.zeros(64, np.int64), xxhash.xxh64_intdigest, memoryview(joined)
    for low in range(0, len(starts), _CHUNK):
        pieces = zip(starts[low : low + _CHUNK], stops[low : low + _CHUNK], strict=True)
        hashes = np.fromiter((digest(view[a : b - 1], SEED) for a, b in pieces), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``id, fp`` per row; ``fp`` is the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint_of(t.as_py(), words_per_shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(batches, f"`{id_column}` {kind}, fp long")


# --- index ---------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over fingerprints sorted by bucket and Gray rank; no node spans two buckets."""

    def __init__(self, buckets: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), buckets))
        self.order, self.fps = order, fps[order]
        bucket = buckets[order]
        # Level 0: the fingerprints themselves, each agreeing with itself on every bit.
        self.levels = [(np.full(len(fps), ~np.uint64(0)), self.fps, np.zeros(0, np.int64))]
        low, high, fan = self.fps, self.fps, LEAF
        while True:
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            if len(first) == len(bucket) and len(self.levels) > 1:
                break
            position = np.arange(len(bucket)) - np.repeat(first, np.diff(np.r_[first, len(bucket)]))
            starts = np.flatnonzero(position % fan == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            bucket, fan = bucket[starts], FAN
            agreed = ~(low ^ high)
            self.levels.append((agreed, low & agreed, np.r_[starts, len(position)]))

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of linked fingerprints, slice by slice."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        stack = [(top, roots[i : i + SLICE], roots[i : i + SLICE]) for i in range(0, len(roots), SLICE)]
        while stack:
            level, a, b = stack.pop()
            mask, value, children = self.levels[level]
            near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= distance
            a, b = a[near], b[near]
            if level == 0:
                other = a != b
                yield self.order[a[other]], self.order[b[other]]
                continue
            wide = LEAF if level == 1 else FAN
            step = max(1, SLICE // (wide * wide))
            for i in range(0, len(a), step):
                left, right = a[i : i + step], b[i : i + step]
                x = children[left][:, None, None] + np.arange(wide)[None, :, None]
                y = children[right][:, None, None] + np.arange(wide)[None, None, :]
                x, y = np.broadcast_arrays(x, y)
                inside = (x < children[left + 1][:, None, None]) & (y < children[right + 1][:, None, None])
                inside &= (left != right)[:, None, None] | (x <= y)
                if inside.any():
                    stack.append((level - 1, x[inside], y[inside]))


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the linked positions; the smallest position of a set is its root."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _edges(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, fp)`` of whole buckets to edges ``(u, v)``: each fingerprint with its root in this task."""
    read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not read:
        return
    bucket = np.concatenate([x for x, _ in read])
    distinct, position = np.unique(np.concatenate([y for _, y in read]).view(np.uint64), return_inverse=True)
    _, bucket = np.unique(bucket, return_inverse=True)
    index = GrayIndex(bucket, distinct[position])
    parent = np.arange(len(distinct))
    for a, b in index.links(distance):
        parent = _join_up(parent, position[a], position[b])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    signed = distinct.view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[parent[moved]])], names=["u", "v"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _cut(mask: int, parts: int) -> list[int]:
    """Masks that add one of ``parts`` blocks of the bits outside ``mask``."""
    rest = [i for i in range(64) if not mask >> i & 1]
    if len(rest) < parts:
        return []
    bounds = [len(rest) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in rest[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def fingerprint_links(distinct: DataFrame, distance: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct fingerprints ``fp`` within ``distance`` bits.

    Two fingerprints are connected by edges exactly if a chain of near ones connects them.
    """
    spark = distinct.sparkSession
    waiting, masks, settled = distinct.select("fp"), [0], []
    waiting = waiting.withColumn("mask", F.lit(0).cast("long"))
    while masks:
        blocks = {m: _cut(m, distance + 1) for m in masks}
        options = F.coalesce(
            *[
                F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)).cast("long") for x in cut]))
                for m, cut in blocks.items()
            ]
        )
        rows = waiting.select("fp", F.explode(options).alias("mask"))
        rows = written(rows.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask")))), "buckets")
        crowded = rows.groupBy("mask", "bucket").count().filter(F.col("count") > bucket_rows).select("mask", "bucket")
        crowded = written(crowded, "crowded")
        names = {_signed(x): x for cut in blocks.values() for x in cut if _cut(x, distance + 1)}
        masks = [names[r["mask"]] for r in crowded.select("mask").distinct().collect() if r["mask"] in names]
        if not masks:
            settled.append(rows)
            break
        crowded = crowded.filter(F.col("mask").isin([_signed(m) for m in masks]))
        settled.append(rows.join(crowded, ["mask", "bucket"], "left_anti").select("fp", "mask", "bucket"))
        waiting = rows.join(crowded, ["mask", "bucket"], "left_semi").select("fp", "mask")
    buckets = settled[0]
    for more in settled[1:]:
        buckets = buckets.unionByName(more)
    tasks = _tasks(spark, buckets)
    return (
        buckets.select("bucket", "fp")
        .repartition(tasks, "bucket")
        .mapInArrow(lambda it: _edges(it, distance), "u long, v long")
    )


def _tasks(spark: SparkSession, buckets: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets.count() // ROWS_PER_TASK))


# --- operator ------------------------------------------------------------------------------------


def simhash_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 3,
    distance: int = 3,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id that links reach."""
    rows = written(fingerprints(docs, id_column, text, words_per_shingle), "fingerprints").withColumnRenamed(id_column, "doc_id")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    stars = components(fingerprint_links(distinct, distance, bucket_rows))  # node, root
    linked = written(
        distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        ),
        "linked",
    )
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    smallest = written(smallest, "components")
    # Only components of several fingerprints need a second look; the others are named already.
    alone = linked.join(smallest.filter("n > 1"), "root", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    shared = linked.join(smallest.filter("n > 1"), "root").select("fp", "component_id")
    named = written(alone.unionByName(shared), "named")
    return attach(rows, named, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, words_per_shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component.

    That is the one with the smallest id, and of rows that share this id the one with the smallest
    fingerprint. Dropped rows are named by id, so texts are shuffled only if those are too many
    to be broadcast. Where an id has rows that stay and rows that go, its rows are told apart by
    fingerprint. A row with a null id stays.
    """
    classes = simhash_classes(docs, words_per_shingle=words_per_shingle, distance=distance)
    known = classes.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "component_id", "fp").agg(F.count(F.lit(1)).alias("rows"))
    known = written(known, "classes_by_id")
    heads = known.filter("doc_id = component_id").groupBy("component_id").agg(F.min("fp").alias("first_fp"))
    heads = heads.select(F.col("component_id").alias("doc_id"), "component_id", "first_fp")
    rows = known.join(heads, ["doc_id", "component_id"], "left").withColumn("stays", F.coalesce(F.col("fp") == F.col("first_fp"), F.lit(False)))
    rows = written(rows.select("doc_id", "fp", "rows", "stays"), "representatives")
    ids = rows.groupBy("doc_id").agg(F.max("stays").alias("some"), F.min("stays").alias("all"), F.max(F.col("rows").cast("long")).alias("most"))
    mixed = F.col("some") & (~F.col("all") | (F.col("most") > 1))
    dropped = written(ids.filter(mixed | ~F.col("some")).select("doc_id"), "dropped_ids")
    kept = attach_small(docs, dropped, ["doc_id"], 32, "left_anti").select(*docs.columns)
    unclear = written(ids.filter(mixed).select("doc_id"), "unclear_ids")
    if unclear.isEmpty():
        return kept
    # Whole rows of the ids in question, each under a number of its own, and their fingerprints.
    again = written(
        attach_small(docs, unclear, ["doc_id"], 32, "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), "unclear_rows"
    )
    number = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "doc_id")
    again = written(again.select(number.alias("key"), "doc_id", "text", "row"), "numbered_rows")
    fps = fingerprints(again, "key", "text", words_per_shingle)
    fps = fps.select("key", F.col("key.doc_id").alias("doc_id"), "fp").join(rows.filter("stays").select("doc_id", "fp"), ["doc_id", "fp"])
    first = fps.groupBy("doc_id").agg(F.min("key").alias("key")).select("key")
    return kept.unionByName(again.join(first, "key").select("row.*"))


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
