"""Run registered queries against their SQL twins: ``python -m registry.check [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from growthlens.plans.materialise import release
from growthlens.session import local_session
from registry.oracle import SQL
from registry.queries import QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype({c: "float64" for c in df.columns if str(df[c].dtype).lower().startswith(("int", "float", "decimal"))})
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same rows, exactly; otherwise what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = ordered(got), ordered(want)
    unequal = ~((a == b) | (a.isna() & b.isna()))
    if not unequal.to_numpy().any():
        return None
    rows = unequal.any(axis=1)
    columns = list(unequal.columns[unequal.any()])
    return f"{int(rows.sum())} rows differ in {columns}\n{a[rows].head(3)}\n{b[rows].head(3)}"


def main(folder: str, names: list[str]) -> int:
    spark, con, failed = local_session(), connect(folder), 0
    for name in names or QUERIES:
        started = time.time()
        got = QUERIES[name](spark, folder).toPandas()
        seconds = time.time() - started
        release(spark)
        if name not in SQL:
            print(f"rows  {name}: {len(got)} rows, {seconds:.1f} s", flush=True)
            continue
        problem = differences(got, con.execute(SQL[name]).df())
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '}  {name}: {len(got)} rows, {seconds:.1f} s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) > 0)
