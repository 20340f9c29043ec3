"""The training-data pipeline: language ID, exact dedup, SimHash near-dedup,
source mixing, packing. Every stage reads what the stage before it wrote.

``run`` writes each stage as Parquet to the shared folder and reads it again,
so a lost executor costs at most the stage it was in. The rows of ``run`` are
those of the last stage; SQL can express neither the language model nor
SimHash, so ``ORACLE_SQL`` is None and tests compare with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, langid, mixing, packing, simhash
from tessera.llm.common import documents, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language (``und``)."""
    found = langid.with_language(docs.withColumnsRenamed({"lang_pred": "__own_pred", "score": "__own_score"}), langid.train(docs))
    kept = found.filter(found["lang_pred"] != langid.UND).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__own_pred": "lang_pred", "__own_score": "score"})


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (never, once or twice)."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
