"""Centroid clustering of integer vectors by a tournament of linear sign tests.

For a pair of centroids the perpendicular bisector has an integer normal and threshold. A
vector starts with the centroid of smallest number and meets the others in order: one
product with the normal of the two decides by its sign which of them loses, zero favours the
smaller number. After k - 1 tests the last one standing is the nearest, and only its
distance is computed. All numbers are integers, so every result is exact and independent of
the order of rows.

A round is one pass over the written vectors: tasks add up their own vectors per centroid,
Spark adds those sums, and at most k rows of ``dimensions`` numbers reach the driver.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component take no part. Rows count singly, whatever their ids; a null id cannot start a
centroid. Equal hashes (of a repeated id) go by the vector's components. With fewer than k
vectors there are as many centroids as vectors. A distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from growthlens.llm.common import written

SAFE = 1 << 26  # components up to here keep all products and sums of squares within 64 bits
SAFE_DIMENSIONS = 512  # for as many dimensions
LIMB = 40  # bits of each part in which sums travel
LIMBS = 5


def integer_vectors(rows: DataFrame, id_column: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """Written table ``id, vector array<double>`` of ``floor(scale * x)`` for the vectors that take part.

    The integers are held as doubles, which they are exactly, since a component's product with a power of two is.
    """
    if scale & (scale - 1) or scale < 1:
        raise ValueError("the scale must be a power of two")
    value = F.col(vector)
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    kept = rows.filter((F.size(value) == dimensions) & usable)
    scaled = F.transform(value, lambda x: _floor(x.cast("double") * scale))
    return written(kept.select(F.col(id_column), scaled.alias("vector")), "integer_vectors")


def _floor(x):
    """The floor as a double; from 2^52 on a double has no fraction, and Spark's floor would leave 64 bits."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def first_centroids(vectors: DataFrame, id_column: str, k: int, salt: str) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of ``<salt>:<id>``, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_column).cast("string")), 256)
    first = vectors.filter(F.col(id_column).isNotNull()).select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(k)
    return [[int(x) for x in row["vector"]] for row in first.collect()]


def _matrix(column: pa.ListArray, dimensions: int, safe: bool) -> np.ndarray:
    """Vectors as integers: 64-bit ones, or Python's own where those could overflow."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if safe and (not values.size or np.abs(values).max() <= SAFE):
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(-1, dimensions)


class Tournament:
    """The bisectors of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.dimensions = len(centroids[0])
        self.safe = self.dimensions <= SAFE_DIMENSIONS and max((abs(x) for c in centroids for x in c), default=0) <= SAFE
        c = np.array(centroids, np.int64 if self.safe else object)
        self.centroids = c
        # x is nearer to j than to i where normals[i, j] . x exceeds thresholds[i, j].
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        squares = (c * c).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row, the smaller number among equals."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            for i in np.unique(best):  # rows whose champion is i meet j
                rows = np.flatnonzero(best == i)
                beaten = x[rows] @ self.normals[i, j] > self.thresholds[i, j]
                best[rows[beaten.astype(bool)]] = j
        return best

    def distances(self, x: np.ndarray, best: np.ndarray) -> list[int | None]:
        """Squared distances to the winners; None beyond 64 bits."""
        if x.dtype == object or not self.safe:
            gaps = x.astype(object) - self.centroids.astype(object)[best]
            return [d if (d := sum(int(g) * int(g) for g in row)) < 1 << 63 else None for row in gaps]
        gaps = x - self.centroids[best]
        return (gaps * gaps).sum(axis=1).tolist()


def _limbs(value: int) -> list[int]:
    parts = []
    for _ in range(LIMBS - 1):
        parts.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*parts, value]


def _round(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid replaced by the floor of its vectors' mean."""
    dimensions = len(centroids[0])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        sums: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for batch in it:
            x = _matrix(batch.column(0), dimensions, tournament.safe)
            best = tournament.winners(x)
            for c in np.unique(best).tolist():
                rows = x[best == c]
                held = sums.get(c, [0] * dimensions)
                sums[c] = [a + int(b) for a, b in zip(held, rows.sum(axis=0).tolist(), strict=True)]
                counts[c] = counts.get(c, 0) + len(rows)
        found = [(c, counts[c], d, *_limbs(v)) for c, values in sums.items() for d, v in enumerate(values)]
        columns = list(zip(*found, strict=True)) or [[]] * (3 + LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    names = ["cluster", "n", "dimension", *[f"limb{i}" for i in range(LIMBS)]]
    schema = ", ".join(f"{n} long" for n in names)
    partial = vectors.select("vector").mapInArrow(batches, schema)
    total = partial.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), *[F.sum(f"limb{i}").alias(f"limb{i}") for i in range(LIMBS)])
    out = [list(c) for c in centroids]
    for row in total.collect():  # at most one row per centroid and dimension
        value = sum(row[f"limb{i}"] << (LIMB * i) for i in range(LIMBS))
        out[row["cluster"]][row["dimension"]] = value // row["n"]
    return out


def cluster(
    rows: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dimensions: int = 64,
    scale: int = 1024,
    salt: str = "3",
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector that takes part."""
    spark = rows.sparkSession
    if k < 1 or rounds < 0:
        raise ValueError("need at least one centroid and no negative number of rounds")
    kind = rows.schema[id_column].dataType.simpleString()
    integers = integer_vectors(rows, id_column, vector, dimensions, scale)
    centroids = first_centroids(integers, id_column, k, salt)
    if not centroids:
        schema = f"`{id_column}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = _round(integers, centroids)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for batch in it:
            x = _matrix(batch.column(1), dimensions, tournament.safe)
            best = tournament.winners(x)
            distances = pa.array(tournament.distances(x, best), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.int32()), distances], names=[id_column, "cluster", "distance"]
            )

    assigned = integers.select(id_column, "vector").mapInArrow(batches, f"`{id_column}` {kind}, cluster int, distance long")
    assigned = written(assigned, "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.count(F.lit(1)) == F.count("distance")
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.when(whole, wide).alias("total")).collect()}
    total = None if None in sums.values() else sum(int(x) for x in sums.values())
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = [(c, fits(s), fits(total), digests[c]) for c, s in sums.items()]
    schema = T.StructType(
        [
            T.StructField("cluster", T.IntegerType()),
            T.StructField("cluster_inertia", T.LongType()),
            T.StructField("inertia", T.LongType()),
            T.StructField("centroid_sha256", T.StringType()),
        ]
    )
    groups = F.broadcast(spark.createDataFrame(found, schema))  # at most k rows
    columns = [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return assigned.join(groups, "cluster").select(*columns)
