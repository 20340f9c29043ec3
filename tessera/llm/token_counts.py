"""Operator 8, token counts: delta-maintained rollups.

The rollup is a folder of committed batches. A batch of signed changes
(``+1`` insert, ``-1`` delete; a revised count is both) is aggregated to one
row per (source, lang, tokenizer) before it is written under its own batch
name, entered in the log, and becomes visible by the mark that is written
last. Totals are the sums over the committed batches. Committing a batch name
again changes nothing, whether the first try succeeded (skipped) or died
half-way (written anew). ``compact`` folds committed batches into one of
another rollup, whose log keeps their names, so they cannot be committed there
again. A batch name stands for the same changes in all rollups that are folded
into one.

Defined cases: null source or language is a group of its own; null and empty
texts are documents with no token; repeated rows count each; deletes may come
before inserts; an empty batch commits and adds nothing; groups whose totals
are all zero are left out.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.ngrams import slices
from tessera.llm.tokens import default_tokenizer, tokenizer

KEYS = ["source", "lang", "tokenizer"]
LOG = "batch string, folds array<string>"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_count(path: str | None = None):
    """Column function: tokens of a text under the tokenizer file."""
    path = path or default_tokenizer()

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        parts = [tokenizer(path).counts(p) for _, p in slices(texts, 3 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count


def counted_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``source, lang, words, pieces`` of every document: white-space words and
    tokens under the tokenizer file, in one pass over slices of bounded size."""
    path = path or default_tokenizer()

    def run(batches):
        for batch in batches:
            for start, part in slices(batch.column(2), 3 << 20):
                words, pieces = tokenizer(path).word_and_token_counts(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)),
                                                  pa.array(words), pa.array(pieces)], ["source", "lang", "words", "pieces"])

    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(
        run, "source string, lang string, words long, pieces long")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(1))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same documents with old and new counts."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Additive totals under ``path`` (a folder in shared storage)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        """Spark's reader answers for any store it knows."""
        from pyspark.errors import AnalysisException
        try:
            self.spark.read.format("binaryFile").load(f"{self.path}/batch={name}/_done")
            return True
        except AnalysisException:
            return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed changes (``KEYS``, ``tokens``, ``sign``); False if the
        batch was committed before."""
        log = self._log()
        if self._exists(batch):
            if batch not in log:        # marked by a version that wrote the log last
                self._register(batch)
            return False
        if any(batch in folds and self._exists(b) for b, folds in log.items()):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"),
                                           F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("n_tokens"))
        self._write(batch, delta)
        return True

    def _write(self, batch: str, delta: DataFrame, folds: list[str] | None = None):
        """The mark comes last: a try that dies before it counts nothing, and
        every marked batch is in the log."""
        folder = f"{self.path}/batch={batch}"
        delta.write.mode("overwrite").parquet(f"{folder}/delta")
        self._register(batch, folds)
        self.spark.range(1).write.mode("overwrite").parquet(f"{folder}/_done")

    def _register(self, batch: str, folds: list[str] | None = None):
        self.spark.createDataFrame([(batch, folds)], LOG).write.mode("append").json(f"{self.path}/log")

    def _log(self) -> dict[str, set[str]]:
        """Every batch tried, with the names of the batches folded into it."""
        from pyspark.errors import AnalysisException
        try:
            rows = self.spark.read.schema(LOG).json(f"{self.path}/log").distinct().collect()
        except AnalysisException:
            return {}
        log: dict[str, set[str]] = {}
        for batch, folds in rows:
            log.setdefault(batch, set()).update(folds or ())
        return log

    def _committed(self) -> dict[str, set[str]]:
        return {b: folds for b, folds in self._log().items() if self._exists(b)}

    def batches(self) -> list[str]:
        """Committed batches; the log names the tries, the mark decides."""
        return sorted(self._committed())

    def totals(self) -> DataFrame:
        return self._sums(self.batches())

    def _sums(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], TOTALS)
        deltas = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/batch={b}/delta" for b in names])
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")) \
                     .filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self, into: "Rollup") -> bool:
        """Fold everything committed here that another rollup does not hold yet
        into one batch of it, named by what it holds; False if there is nothing."""
        mine, theirs = self._committed(), into._committed()
        held = set(theirs).union(*theirs.values())
        new = sorted(set(mine) - held)
        if not new:
            return False
        folds = sorted(set(new).union(*(mine[b] for b in new)))
        twice = held.intersection(folds)
        if twice:
            raise ValueError(f"batches {sorted(twice)} are in the target and cannot be taken out of a compacted batch")
        into._write(f"compacted-{hashlib.sha1(json.dumps(folds).encode()).hexdigest()}", self._sums(new), folds)
        return True


def load(rollup: Rollup, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Count all documents into ``rollup`` under two tokenizer versions and
    return its totals: white-space words; then the tokenizer file, entered with
    the word counts as estimates (committed twice, which counts once) and
    revised to its own counts. The totals hold every document."""
    from tessera.llm.common import stage

    counted = stage(counted_documents(docs, path), "counts")

    def version(name: str, column: str) -> DataFrame:
        return counted.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(column).alias("tokens"))

    estimates = version("word_bpe_49k", "words")
    rollup.commit("1-words", inserts(version("words", "words")))
    rollup.commit("2-estimates", inserts(estimates))
    rollup.commit("2-estimates", inserts(estimates))
    rollup.commit("3-counts", revisions(estimates, version("word_bpe_49k", "pieces")))
    return rollup.totals()
