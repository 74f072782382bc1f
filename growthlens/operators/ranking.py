"""Global ranks and exact quantiles without a single-partition sort.

``rank()`` over an unpartitioned window moves every row into one task. Here the
value range is cut at quantiles of a bounded sample into buckets of similar size;
each bucket is ranked on its own and shifted by the weight of the buckets below it.
The cuts are numbers fixed before the job, so a row's bucket depends on its
value alone and a recomputed task places it identically. The result is exact
whatever the cuts are; they only balance the work. The sample is chosen by a hash of
the row, so no sketches of all tasks meet in one, and the number of buckets follows
from the number of rows.

A value frequent enough to fill a bucket gets a bucket of its own. Its rank
follows from the bucket counts, so its rows need no sort and are spread out.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from growthlens.config import col_names
from growthlens.plans.attach import shuffle_partitions, slice_of

BUCKET_ROWS = 4_000_000  # rows that one window task orders, on average
BUCKETS_PER_PARTITION = 4
SAMPLE_PER_BUCKET = 16  # sampled rows behind each cut
LEAST_SAMPLE = 10_000


@dataclass(frozen=True)
class RankStep:
    """Where one column's buckets start, and the lookup of weights below each bucket."""

    column: str
    cuts: list[float]
    single: set[int]
    offsets: list[tuple[int, bool, int, int]]
    total: int


def _clean(column: str) -> Column:
    # Adding 0.0 turns -0.0 into 0.0, so that both tie.
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)


def _bucket_count(df: DataFrame, rows: int) -> int:
    return max(2, shuffle_partitions(df.sparkSession) * BUCKETS_PER_PARTITION, -(-rows // BUCKET_ROWS))


def rank_sample(df: DataFrame, columns: Sequence[str], rows: int, buckets: int) -> DataFrame:
    """Values of a sample of rows, whose size follows from the number of buckets; chosen in the scan, without a shuffle."""
    wanted = max(LEAST_SAMPLE, SAMPLE_PER_BUCKET * buckets)
    slots = 1 << 40
    sample = df.select(*[_clean(c).alias(f"_{i}") for i, c in enumerate(columns)], F.xxhash64(*df.columns).alias("_h"))
    if rows > wanted:
        sample = sample.filter(F.pmod("_h", F.lit(slots)) < F.lit(slots * wanted // rows))
    return sample.drop("_h")


def _sampled_quantiles(df: DataFrame, columns: Sequence[str], rows: int, buckets: int) -> list[list[float]]:
    """Per column, ``buckets - 1`` quantiles of the sample."""
    found = rank_sample(df, columns, rows, buckets).toPandas()
    out = []
    for name in found.columns:
        values = found[name].dropna().sort_values().to_numpy()
        out.append([float(values[len(values) * i // buckets]) for i in range(1, buckets)] if len(values) else [0.0])
    return out


def _cuts(quantiles: Sequence[float]) -> tuple[list[float], set[int]]:
    """Bucket borders, and the positions of buckets that hold one value only."""
    values = sorted(quantiles)
    repeated = {a for a, b in zip(values, values[1:]) if a == b}
    borders = set(values) | {math.nextafter(v, math.inf) for v in repeated}
    cuts = [-math.inf, *sorted(borders), math.inf]
    return cuts, {bisect.bisect_left(cuts, v) for v in repeated}


def _with_buckets(df: DataFrame, columns: Sequence[str], cuts: Sequence[list[float]]) -> DataFrame:
    names = [f"_bucket_{c}" for c in columns]
    step = Bucketizer(
        inputCols=[f"_value_{c}" for c in columns],
        outputCols=names,
        splitsArray=[list(c) for c in cuts],
        handleInvalid="keep",
    )
    df = df.withColumns({f"_value_{c}": _clean(c) for c in columns})
    return step.transform(df).withColumns({n: F.col(n).cast("int") for n in names})


def _plan_ranks(df: DataFrame, columns: Sequence[str], weight: Column) -> list[RankStep]:
    """Two passes over the ranked columns: a sample for the cuts of all of them, then weights per bucket."""
    rows = df.count()
    cut_lists = [_cuts(q) for q in _sampled_quantiles(df, columns, rows, _bucket_count(df, rows))]

    bucketed = _with_buckets(df.select(*columns, weight.alias("_weight")), columns, [c for c, _ in cut_lists])
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("column"), F.col(f"_bucket_{c}").alias("bucket"))
                for i, c in enumerate(columns)
            ]
        )
    )
    # At most (number of columns) x (2 x buckets + 2) rows reach the driver.
    weights = (
        bucketed.select(cells.alias("cell"), "_weight")
        .groupBy("cell.column", "cell.bucket")
        .agg(F.sum("_weight").alias("weight"))
        .filter(F.col("bucket").isNotNull())
        .collect()
    )
    per_column: dict[int, dict[int, int]] = {}
    for row in weights:
        per_column.setdefault(row["column"], {})[row["bucket"]] = row["weight"]

    steps = []
    for i, (column, (cuts, single)) in enumerate(zip(columns, cut_lists)):
        below, offsets = 0, []
        for bucket, amount in sorted(per_column.get(i, {}).items()):
            offsets.append((bucket, bucket in single, below, amount))
            below += amount
        steps.append(RankStep(column, cuts, single, offsets, below))
    return steps


_OFFSET_SCHEMA = T.StructType(
    [
        T.StructField("_bucket", T.IntegerType()),
        T.StructField("_single", T.BooleanType()),
        T.StructField("_below", T.LongType()),
        T.StructField("_inside", T.LongType()),
    ]
)


def _rank_one(df: DataFrame, step: RankStep, weight: Column, keys: Sequence[str]) -> DataFrame:
    """Add ``_lower``, the weight of smaller values, and ``_ties``, the weight of equal ones."""
    value, bucket = f"_value_{step.column}", f"_bucket_{step.column}"
    offsets = df.sparkSession.createDataFrame(step.offsets, _OFFSET_SCHEMA)
    df = df.join(F.broadcast(offsets.withColumnRenamed("_bucket", bucket)), bucket, "left")

    # Rows of a one-value bucket, and rows without a value, need no order: spread
    # them, and order them by a hash so that the window sees no long run of ties.
    loose = F.coalesce(F.col("_single"), F.lit(True))
    slices = F.lit(max(2, len(step.offsets)))
    df = df.withColumns(
        {
            "_slice": F.when(loose, slice_of(keys, slices)).otherwise(F.lit(0)),
            "_order": F.when(loose, F.xxhash64(*keys).cast("double")).otherwise(F.col(value)),
        }
    )
    ordered = Window.partitionBy(bucket, "_slice").orderBy("_order")
    up_to_here = F.sum(weight).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(weight).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return (
        df.withColumns({"_up_to": up_to_here, "_tied": ties})
        .withColumns(
            {
                "_lower": F.when(F.col("_single"), F.col("_below")).otherwise(
                    F.col("_below") + F.col("_up_to") - F.col("_tied")
                ),
                "_ties": F.when(F.col("_single"), F.col("_inside")).otherwise(F.col("_tied")),
            }
        )
        .drop("_slice", "_order", "_up_to", "_tied", "_single", "_below", "_inside", bucket, value)
    )


def _rank_value(method: str, ascending: bool, pct: bool, total: int) -> Column:
    lower, ties = F.col("_lower"), F.col("_ties")
    first = lower + 1 if ascending else F.lit(total) - lower - ties + 1
    if method == "min":
        rank = first
    elif method == "average":
        rank = first + (ties - 1) / 2
    else:
        raise ValueError(f"unknown rank method {method!r}")
    if pct:
        return rank / F.lit(max(total, 1))
    return rank.cast("long") if method == "min" else rank


def global_rank(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str],
    method: str = "min",
    ascending: bool = False,
    pct: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """``df`` plus a rank over all rows for each ``{source column: rank column}``.

    ``method`` is ``min`` (competition rank) or ``average`` (ties share their
    mean rank); ``pct`` divides by the number of ranked rows. NULL and NaN get
    no rank. ``weight`` names an integer column saying how many rows each row
    stands for. ``keys`` identify a row. ``df`` is read three or four times and should
    be a written table. Several columns are ranked together, through one window.
    """
    keys = col_names(keys)
    source = list(columns)
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    steps = _plan_ranks(df, source, amount)
    if len(steps) > 1:
        ranks = _ranks_together(df, steps, amount, keys, lambda step: _rank_value(method, ascending, pct, step.total))
        same = _all_of([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        joined = df.alias("l").join(ranks.alias("r"), same, "left")
        return joined.select("l.*", *[F.col(f"r._rank_{i}").alias(columns[c]) for i, c in enumerate(source)])
    out = df
    for step in steps:
        out = _with_buckets(out, [step.column], [step.cuts])
        out = _rank_one(out, step, amount, keys)
        rank = _rank_value(method, ascending, pct, step.total)
        out = out.withColumn(columns[step.column], rank).drop("_lower", "_ties")
    return out


def _all_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def _ranks_together(
    df: DataFrame, steps: Sequence[RankStep], weight: Column, keys: Sequence[str], rank: Callable[[RankStep], Column]
) -> DataFrame:
    """``keys, _rank_0, _rank_1, ...``: the ranks of all columns through one window over narrow rows.

    A row becomes one row of key, weight, column number and value per ranked column that has a
    value. Those are dealt out by column and bucket once, and the ranks are put side by side by key.
    """
    columns = [s.column for s in steps]
    narrow = _with_buckets(df.select(*keys, *[c for c in columns if c not in keys], weight.alias("_weight")), columns, [s.cuts for s in steps])
    cells = F.array(
        *[F.struct(F.lit(i).alias("_column"), F.col(f"_bucket_{c}").alias("_bucket"), F.col(f"_value_{c}").alias("_value")) for i, c in enumerate(columns)]
    )
    valued = F.filter(cells, lambda x: x["_value"].isNotNull())
    narrow = narrow.select(*keys, "_weight", F.explode(valued).alias("_cell")).select(*keys, "_weight", "_cell.*")
    offsets = [(i, *o) for i, s in enumerate(steps) for o in s.offsets]
    schema = T.StructType([T.StructField("_column", T.IntegerType()), *_OFFSET_SCHEMA.fields])
    bounds = df.sparkSession.createDataFrame(offsets, schema)
    narrow = narrow.join(F.broadcast(bounds.select("_column", "_bucket", "_single")), ["_column", "_bucket"], "left")
    loose = F.coalesce(F.col("_single"), F.lit(True))
    slices = F.lit(max(2, *[len(s.offsets) for s in steps]))
    narrow = narrow.withColumns(
        {
            "_slice": F.when(loose, slice_of(keys, slices)).otherwise(F.lit(0)),
            "_order": F.when(loose, F.xxhash64(*keys).cast("double")).otherwise(F.col("_value")),
        }
    ).drop("_single")
    ordered = Window.partitionBy("_column", "_bucket", "_slice").orderBy("_order")
    up_to_here = F.sum("_weight").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("_weight").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    narrow = narrow.withColumns({"_up_to": up_to_here, "_tied": ties})
    narrow = narrow.join(F.broadcast(bounds), ["_column", "_bucket"], "left")  # after the shuffle, which is spared the weights
    narrow = narrow.withColumns(
        {
            "_lower": F.when(loose, F.col("_below")).otherwise(F.col("_below") + F.col("_up_to") - F.col("_tied")),
            "_ties": F.when(loose, F.col("_inside")).otherwise(F.col("_tied")),
        }
    )
    side_by_side = [F.max(F.when(F.col("_column") == i, rank(s))).alias(f"_rank_{i}") for i, s in enumerate(steps)]
    return narrow.groupBy(*keys).agg(*side_by_side)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row per column and probability: the linearly interpolated exact quantile.

    Only the buckets that hold a wanted position are sorted, and within them
    only distinct values with their counts.
    """
    columns = col_names(columns)
    steps = _plan_ranks(df, columns, F.lit(1).cast("long"))
    parts = [_quantiles_of(df, step, probabilities) for step in steps]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _quantiles_of(df: DataFrame, step: RankStep, probabilities: Sequence[float]) -> DataFrame:
    positions = []
    for p in probabilities:
        exact = p * (step.total - 1)
        low = math.floor(exact)
        positions.append((p, low, min(low + 1, step.total - 1), exact - low))
    wanted = {q for _, low, high, _ in positions for q in (low, high)}
    needed = [b for b, _, below, inside in step.offsets if any(below <= q < below + inside for q in wanted)]

    offsets = df.sparkSession.createDataFrame(step.offsets, _OFFSET_SCHEMA)
    value, bucket = f"_value_{step.column}", f"_bucket_{step.column}"
    runs = (
        _with_buckets(df.select(step.column), [step.column], [step.cuts])
        .filter(F.col(bucket).isin(needed))
        .groupBy(F.col(bucket).alias("_bucket"), F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(F.broadcast(offsets), "_bucket")
    )
    up_to = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_value"))
    runs = runs.withColumn("_end", F.col("_below") + up_to).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(position: int) -> Column:
        here = (F.col("_start") <= position) & (F.col("_end") > position)
        return F.max(F.when(here, F.col("_value")))

    found = runs.agg(
        *[at(low).alias(f"_low_{i}") for i, (_, low, _, _) in enumerate(positions)],
        *[at(high).alias(f"_high_{i}") for i, (_, _, high, _) in enumerate(positions)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(step.column).alias("column"),
                    F.lit(float(p)).alias("probability"),
                    (
                        F.col(f"_low_{i}") + (F.col(f"_high_{i}") - F.col(f"_low_{i}")) * F.lit(float(fraction))
                    ).alias("value"),
                )
                for i, (p, _, _, fraction) in enumerate(positions)
            ]
        )
    ).alias("row")
    return found.select(rows).select("row.*")
