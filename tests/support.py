"""Shared helpers: one session for all tests, and the Spark-versus-SQL comparison."""

from __future__ import annotations

import os
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUIRECHECK_DRIVER_MEMORY", "12g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[str, int, float]:
    """What differs ('' when both sides agree), the number of rows, and the seconds SQL took."""
    got = [tuple(r) for r in df.collect()]
    start = time.time()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    return _difference(df, names, got, want), len(got), time.time() - start


def _difference(df, names, got, want) -> str:
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    g, w = _canonical(df.columns, got), _canonical(names, want)
    wrong = [(a, b) for a, b in zip(g, w) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(g)} rows differ, first: {wrong[0][0][:400]} != {wrong[0][1][:400]}"
    return ""
