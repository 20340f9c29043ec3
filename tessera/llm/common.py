"""Shared helpers of the training-data operators: tables, stage cuts,
column-name hygiene and the fixed train / held-out fold."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

WORD_BREAKS = r"[\x20\x09-\x0D]+"      # fixed by the contracts: words are [^\x20\x09-\x0D]+
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts
    the lineage, and later steps prune columns of the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return the caller's columns: columns whose names begin
    with ``__``, as those of helper columns do, have other names inside and come
    back unchanged."""
    @wraps(step)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        taken, aside = {c.lower() for c in docs.columns}, {}
        for column in docs.columns:
            if column.startswith("__"):
                name = f"own{len(aside)}"
                while name in taken:
                    name = "own" + name
                taken.add(name)
                aside[column] = name
        return step(docs.withColumnsRenamed(aside), *args, **kw).withColumnsRenamed({v: k for k, v in aside.items()})
    return run


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is exact for pure ASCII texts and much
    cheaper there; other texts go through the per-character mapping."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
            .otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows no model may learn from: crc32(doc_id as text) mod 4 is 2
    (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sampled_rows(df: DataFrame, by: str, cap: int, seed: int) -> DataFrame:
    """At most about ``cap`` rows (``doc_id``, ``by``) of every ``by`` value,
    chosen by a seeded hash of the id; the per-value fractions come from an
    exact count of all rows."""
    rows = df.select("doc_id", by).filter(F.col(by).isNotNull() & F.col("doc_id").isNotNull())
    share = rows.groupBy(by).agg((F.lit(float(cap)) / F.count(F.lit(1))).alias("share"))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return rows.join(share, by).filter(draw < F.col("share")).select("doc_id", by)
