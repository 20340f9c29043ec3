"""Registry of named queries over the driver tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``; when the semantics are
expressible in SQL an oracle string for DuckDB is registered next to it
(tables are views named after the parquet files).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Tables whose rows carry real work (text, vectors, logs). Dimension tables
# (nation, region, part, ...) are left as scanned.
WORK_TABLES = {"documents", "embeddings", "events", "lineitem", "conversations", "pages", "orders", "labels"}


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Round-robin repartition when a scan yields fewer splits than the
    cluster has task slots (a small file with one row group is one split).
    On large inputs the splits far outnumber the slots and this is a no-op,
    so it never adds a shuffle of a big table."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return ensure_parallelism(df) if name in WORK_TABLES else df
