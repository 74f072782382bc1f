"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors form one class, so a vector that a third of the rows share is one node.

Graph. Random projections deal the nodes into blocks of bounded size, in which first
neighbour lists are exact. Blocks by a hash of the id do the same, so a node that is
alone in its cells starts with a full list of chance neighbours. Each round of NN-descent then joins every list with its
reverse, brings the neighbours' vectors together around each node, and compares the
neighbours of a node with one another (only pairs with a new member). Pairs that beat
the longest distance of one of their lists come back and are merged. The neighbours of
a hub are dealt into several groups, each with the hub's own list, so no group grows
with the table and no pair of list and reverse entry is left out of all groups. Rounds
end when few lists change.

Search. All queries walk together: a round joins the unexpanded nodes among the best
``BEAM`` of each query with their lists and reverse lists, measures the nodes not seen
before, and ends when no best node is left to expand. Nearest classes are measured
again on the original vectors, and their members are ranked.

Vectors travel in their own precision, unscaled, and all distances are taken in double
precision, so near copies stay apart whatever else the table holds. State lives in
written tables.

Defined results: vectors that are null or empty, all zero, or hold a null or non-finite
component take no part, nor do those of another length than most (ties: the shorter).
Null ids take no part. Rows that repeat an id count once (with the smallest of its
vectors). Fewer candidates than asked for: all of them. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from growthlens.llm.common import attach_small, bounded_sample, written

NEIGHBOURS = 32  # length of a list
BEAM = 128  # best nodes of a query that get expanded
REMEMBERED = 8  # beams of nodes that a query remembers
BLOCK = 512  # nodes that are compared with each other at the start, at most about
TABLES = 2  # random projections of the nodes
CHANCE = 4  # lists that fit into a block by hash, on average
GROUP = 128  # neighbours of a hub that meet in one group, besides its own list
ROUNDS = 10
SETTLED = 0.01  # share of new list entries below which the graph is done
CANCELLED = 1e-8  # share of the squared lengths below which a distance is taken from differences
SAMPLE = 2_000  # vectors that place the cuts of the projections


@dataclass
class Graph:
    classes: DataFrame  # id, vector (original)
    members: DataFrame  # vec_id, id
    nodes: DataFrame  # id, packed
    edges: DataFrame  # u, v, d
    size: int
    kind: str  # NumPy type of a packed component


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    good = named.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    good = written(good.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vector") == length["n"]) if length else good


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    """A column of packed vectors as one row per vector, without a copy."""
    if not len(column):
        return np.zeros((0, 0), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _packed(classes: DataFrame) -> tuple[DataFrame, str]:
    """``id, packed`` and the type of a component: single precision if the column has it, double otherwise."""
    kind = "f4" if classes.schema["vector"].dataType.elementType.typeName() == "float" else "f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = flat.astype(kind).reshape(batch.num_rows, -1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in rows], pa.binary())], names=["id", "packed"])

    return classes.select("id", "vector").mapInArrow(packed, "id long, packed binary"), kind


def _smallest(u: np.ndarray, v: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``most`` nearest ``v`` of each ``u``."""
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    again = np.r_[False, (u[1:] == u[:-1]) & (v[1:] == v[:-1]) & (d[1:] == d[:-1])]
    u, v, d = u[~again], v[~again], d[~again]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
    place = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
    near = place < most
    return u[near], v[near], d[near]


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances between rows; where the product form loses digits, as sums of squared differences."""
    x = x.astype(np.float64)
    near = x - x[0]
    length = (near * near).sum(1)
    sums = length[:, None] + length[None, :]
    d = sums - 2 * near @ near.T
    i, j = np.nonzero(d < CANCELLED * sums)
    i, j = i[i != j], j[i != j]
    step = max(1, 1_000_000 // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        d[a, b] = ((x[a] - x[b]) ** 2).sum(1)
    np.fill_diagonal(d, 0)
    return d


def _pairs(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(d.astype(np.float64))]
    return pa.RecordBatch.from_arrays(arrays, names=["u", "v", "d"])


def _first_lists(nodes: DataFrame, size: int, most: int, kind: str) -> DataFrame:
    """Exact lists inside blocks of a few random projections and of one hash of the id: ``u, v, d``."""
    bits = int(np.ceil(np.log2(size / (BLOCK / 2)))) if size > BLOCK else 0
    sample = bounded_sample(nodes, "id", SAMPLE, "projections").collect()  # at most SAMPLE vectors
    x = np.frombuffer(b"".join(r["packed"] for r in sample), kind).reshape(len(sample), -1).astype(np.float64)
    planes = [np.random.default_rng(97 + t).normal(size=(x.shape[1], bits)) for t in range(TABLES if bits else 1)]
    cuts = [np.median(x @ p, axis=0) for p in planes]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _vectors(batch.column(1), kind).astype(np.float64)
            for t, (plane, cut) in enumerate(zip(planes, cuts, strict=True)):
                code = ((rows @ plane > cut) << np.arange(bits, dtype=np.int64)).sum(1) if bits else np.zeros(len(rows), np.int64)
                block = pa.array(code.astype(np.int64) * (TABLES + 1) + t)
                yield pa.RecordBatch.from_arrays([block, batch.column(0), batch.column(1)], names=["block", "id", "packed"])

    placed = nodes.mapInArrow(place, "block long, id long, packed binary")
    if bits:
        chance = F.pmod(F.xxhash64(F.lit("start"), "id"), F.lit(max(1, size // (CHANCE * most)))) * (TABLES + 1) + TABLES
        placed = placed.unionByName(nodes.select(chance.alias("block"), "id", "packed"))
    placed = written(placed, "placed")
    crowded = placed.groupBy("block").count().filter(F.col("count") > BLOCK)
    crowded = written(crowded.select("block", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "crowded")
    placed = attach_small(placed, crowded, ["block"], 24)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "block"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def lists(block: pa.Table) -> pa.Table:
        ids, x = block.column("id").to_numpy(), _vectors(block.column("packed").combine_chunks(), kind)
        d = _squares(x)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(most, len(ids) - 1)]
        u, v = np.repeat(ids, near.shape[1]), ids[near].ravel()
        return pa.Table.from_batches([_pairs(u, v, np.take_along_axis(d, near, 1).ravel())])

    return placed.groupBy("block", "part").applyInArrow(lists, "u long, v long, d double")


def _merge(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest per node of ``u, v, d, fresh``; an entry that was there before is not fresh."""
    once = pairs.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return once.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def _neighbourhoods(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Per node and part: its list and reverse list with the nodes' vectors, longest distances and freshness."""
    lists = edges.select(F.col("u").alias("centre"), F.col("v").alias("id"), "fresh")
    reverse = edges.select(F.col("v").alias("centre"), F.col("u").alias("id"), "fresh")
    hubs = reverse.groupBy("centre").count().filter(F.col("count") > GROUP)
    hubs = written(hubs.select("centre", F.ceil(F.col("count") / GROUP).cast("int").alias("parts")), "hubs")
    dealt = attach_small(reverse, hubs, ["centre"], 24).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own = attach_small(lists, hubs, ["centre"], 24).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    around = own.unionByName(dealt).groupBy("centre", "part", "id").agg(F.max("fresh").alias("fresh"))
    longest = edges.groupBy("u").agg(F.max("d").alias("longest"), F.count(F.lit(1)).alias("n"))
    longest = longest.select(F.col("u").alias("id"), F.when(F.col("n") < most, float("inf")).otherwise(F.col("longest")).alias("longest"))
    limits = nodes.join(longest, "id", "left").withColumn("longest", F.coalesce("longest", F.lit(float("inf"))))
    carried = around.join(limits, "id")
    return carried.groupBy("centre", "part").agg(
        F.collect_list("id").alias("ids"), F.collect_list("fresh").alias("fresh"), F.collect_list("longest").alias("longest"), F.collect_list("packed").alias("vectors")
    )


def _local_joins(batches: Iterator[pa.RecordBatch], most: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Pairs of a neighbourhood that beat the longest distance of their first member's list."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        names = batch.schema.names
        ids, fresh, longest, packed = (batch.column(names.index(c)) for c in ("ids", "fresh", "longest", "vectors"))
        ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        all_ids = ids.flatten().to_numpy()
        all_fresh = fresh.flatten().to_numpy(zero_copy_only=False)
        all_longest = longest.flatten().to_numpy()
        vectors = _vectors(packed.flatten(), kind)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            new = all_fresh[a:b] > 0
            if b - a < 2 or not new.any():
                continue
            own, d = all_ids[a:b], _squares(vectors[a:b])
            better = (d < all_longest[a:b, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            kept.append((own[i], own[j], d[i, j]))
            held += len(i)
            if held > 2_000_000:  # merge what this task has so far: the nearest of the union are all that count
                kept = [_smallest(*map(np.concatenate, zip(*kept, strict=True)), most)]
                held = len(kept[0][0])
                if held > 1_000_000:
                    yield _pairs(*kept[0])
                    kept, held = [], 0
    if kept:
        yield _pairs(*_smallest(*map(np.concatenate, zip(*kept, strict=True)), most))


def build_graph(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = NEIGHBOURS) -> Graph:
    """Neighbour lists of the distinct vectors of ``rows``."""
    valid = valid_vectors(rows, id_column, vector)
    classes = written(valid.groupBy("vector").agg(F.min("vec_id").alias("id")).select("id", "vector"), "classes")
    members = written(valid.join(classes, "vector").select("vec_id", "id"), "members")
    size = classes.count()
    nodes, kind = _packed(classes)
    nodes = written(nodes, "nodes")
    if size < 2:
        none = nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("d")).limit(0)
        return Graph(classes, members, nodes, none, size, kind)
    first = _first_lists(nodes, size, most, kind).withColumn("fresh", F.lit(1))
    edges = written(_merge(first, most), "edges")
    for _ in range(ROUNDS if size > BLOCK else 0):
        around = _neighbourhoods(edges, nodes, most)
        found = around.mapInArrow(lambda it: _local_joins(it, most, kind), "u long, v long, d double").withColumn("fresh", F.lit(1))
        edges = written(_merge(edges.withColumn("fresh", F.lit(0)).unionByName(found), most), "edges")
        if edges.agg(F.sum("fresh")).first()[0] < SETTLED * most * size:
            break
    return Graph(classes, members, nodes, edges.select("u", "v", "d"), size, kind)


def _measured(pairs: DataFrame, nodes: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """``q, v, d`` for pairs ``q, v``: each meets its node's vector, then its query's."""
    near = pairs.join(nodes.select(F.col("id").alias("v"), "packed"), "v")
    asked = queries.select("q", F.col("packed").alias("asked"))
    near = attach_small(near, asked, ["q"], 1_024, "inner")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_vectors(batch.column(i), kind).astype(np.float64) for i in (2, 3))
                d = ((a - b) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["q", "v", "d"])

    return near.select("q", "v", "packed", "asked").mapInArrow(measure, "q long, v long, d double")


def search(graph: Graph, queries: DataFrame, count: int = 10, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``count`` nearest found of each ``query_id`` of the graph's members.

    A query starts at its own node.
    """
    asked = graph.members.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id")
    asked = written(asked, "asked")  # vec_id, id: several queries may share a node
    starts = asked.select("id").distinct()
    points = written(starts.join(graph.nodes, "id").select(F.col("id").alias("q"), "packed"), "query_points")
    both = graph.edges.select("u", "v").unionByName(graph.edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = written(both, "adjacency")
    seen = points.select("q", F.col("q").alias("v"), F.lit(0.0).alias("d"), F.lit(0).alias("expanded"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))
    while True:
        seen = written(seen, "seen")
        ranked = seen.withColumn("place", place)
        now = (F.col("place") <= beam) & (F.col("expanded") == 0)
        frontier = written(ranked.filter(now).select("q", F.col("v").alias("u")), "frontier")
        if frontier.isEmpty():
            break
        reached = frontier.join(both, "u").select("q", "v").distinct()
        fresh = reached.join(seen.select("q", "v"), ["q", "v"], "left_anti")
        # Far nodes are forgotten: one that is met again is measured again and stays far.
        kept = ranked.filter(F.col("place") <= REMEMBERED * beam)
        kept = kept.select("q", "v", "d", F.when(now, 1).otherwise(F.col("expanded")).alias("expanded"))
        seen = kept.unionByName(_measured(fresh, graph.nodes, points, graph.kind).withColumn("expanded", F.lit(0)))
    best = ranked.filter(F.col("place") <= max(beam, 2 * count + 2)).select("q", F.col("v").alias("id"))
    return _ranked(graph, asked, written(best, "best"), count)


def _ranked(graph: Graph, asked: DataFrame, best: DataFrame, count: int) -> DataFrame:
    """Exact distances of the found classes, spread over their members."""
    kinds = graph.classes.select("id", "vector")
    exact = best.join(kinds, "id").join(kinds.select(F.col("id").alias("q"), F.col("vector").alias("asked")), "q")
    squares = F.zip_with("vector", "asked", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0).cast("double"), lambda a, x: a + x))
    exact = exact.select("q", "id", score.alias("score"))
    in_class = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    few = graph.members.withColumn("place", in_class).filter(F.col("place") <= count + 1).drop("place")  # the own row may be one
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(exact, "q").join(few, "id")
    pairs = pairs.filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, count: int = 10) -> DataFrame:
    """Search the rows whose id is divisible by ``every`` against all rows."""
    graph = build_graph(rows)
    return search(graph, graph.members.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")), count)
