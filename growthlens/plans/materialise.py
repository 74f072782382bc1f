"""Cut lineage by writing a frame as Parquet into the cluster's shared folder.

A frame that several later passes read (the panel, the pair table) is written
once. Readers then prune columns and push filters into it, a lost executor
costs a re-read and not a recomputation, and every pass sees identical rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

COMPRESSION = "zstd"  # of intermediate tables, which are mostly ids and doubles
BUCKET_ROWS = 4_000_000  # rows of a bucket, which one task reads as a whole

_FALLBACK = "growthlens.scratch.dir"
_TABLE_PREFIX = "growthlens_scratch_"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = spark.conf.get(_FALLBACK, None)
    if folder:
        return folder.rstrip("/")
    folder = tempfile.mkdtemp(prefix="growthlens-")
    spark.conf.set(_FALLBACK, folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables."""
    return f"{shared_folder(spark)}/growthlens-{spark.conf.get('spark.app.id')}"


def materialise(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write ``df`` and return a scan of what was written."""
    path = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(df: DataFrame) -> int:
    """Buckets for a written table, of which none holds more than ``BUCKET_ROWS`` rows on average."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))


def materialise_by(
    df: DataFrame, keys: Sequence[str], name: str, buckets: int | None = None, placed: bool = False
) -> DataFrame:
    """Write ``df`` bucketed by ``keys``, so that grouping by them and joining on them need no shuffle.

    One shuffle here, to write one file per bucket, saves one per later use.
    Buckets are known to the session's table catalog only, hence the table. Their number
    follows from the rows, which are counted first, and ``df`` should be a written table then; or it is
    given, to match another table. ``placed`` spares the shuffle of rows that were grouped by
    the keys of a table with these buckets: each task has one bucket's.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_count(df)
    table = f"{_TABLE_PREFIX}{name}_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").option("compression", COMPRESSION).bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", f"{session_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables, once no frame reads them any more."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_TABLE_PREFIX) and not table.isTemporary:
            location = spark.sql(f"DESCRIBE EXTENDED {table.name}").filter("col_name = 'Location'").first()
            if location and session_folder(spark) in location["data_type"]:
                spark.sql(f"DROP TABLE {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(path, True)
