"""Classification scoring and topic-table handling.

Metrics are native aggregates: accuracy is an average; macro-F1 builds the
confusion counts with one ``groupBy(gold, pred)`` (partial aggregation, so
the shuffle carries at most classes² rows per task), then per-class
marginals. The label set is the union of classes seen in gold and in
predictions; an undefined F1 counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import argmax, logsumexp

# Topic names and their class ids.
TOPICS_6 = ["Recommendation", "Faith", "Violence", "Grace", "Sin", "Description"]
TOPICS_7 = ["science/technology", "travel", "politics", "sports", "health", "entertainment", "geography"]


def topic_map(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, label_id int")


def parse_topics_headerless(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Headerless ``id<TAB>label<TAB>verse`` rows: lines with more than three
    fields are skipped, shorter ones padded; quoting is off; a missing verse
    becomes the text ``nan`` (the stringified missing value)."""
    parts = F.split(F.col(text_col), "\t", -1)
    keep = [c for c in lines.columns if c != text_col]
    t = lines.select(*keep, parts.alias("__p")).filter(F.size("__p") <= 3)
    return t.select(*keep, F.col("__p")[0].alias("id"), F.get(F.col("__p"), 1).alias("label"),
                    F.coalesce(F.get(F.col("__p"), 2), F.lit("nan")).alias("verse"))


def parse_topics_header(lines: DataFrame, file_cols: list[str], header_col: str = "is_header",
                        text_col: str = "text", wanted=("category", "text")) -> DataFrame:
    """TSV with a header line per file: the header row names the columns;
    ``wanted`` columns are picked by name. Headers are one row per file, so
    the join back is against a table of file count size."""
    parts = F.split(F.col(text_col), "\t", -1)
    hdr = lines.filter(F.col(header_col)).select(*file_cols, parts.alias("__h"))
    rows = lines.filter(~F.col(header_col)).select(*file_cols, parts.alias("__p"))
    j = rows.join(hdr, on=file_cols)
    return j.select(*file_cols, *[F.get(F.col("__p"), F.array_position("__h", w).cast("int") - 1).alias(w)
                                  for w in wanted])


def map_labels(df: DataFrame, mapping: DataFrame, label_col: str = "label") -> DataFrame:
    """Topic name → class id by the value map; unmapped
    names pass through with a null id and ``mapped = false``."""
    m = mapping.select(F.col("label").alias("__l"), F.col("label_id"))
    j = df.join(m, df[label_col] == m["__l"], "left").drop("__l")
    return j.withColumn("mapped", F.col("label_id").isNotNull())


def with_argmax(df: DataFrame, logits: str = "logits", out: str = "pred") -> DataFrame:
    return df.withColumn(out, argmax(logits))


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return df.groupBy(*by).agg(F.avg(F.when(F.col(gold) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of per-class F1 over classes in gold ∪ predictions."""
    by = list(by or [])
    conf = df.groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).count()
    tp = conf.filter(F.col("g") == F.col("p")).select(*by, F.col("g").alias("c"), F.col("count").alias("tp"))
    gs = conf.groupBy(*by, F.col("g").alias("c")).agg(F.sum("count").alias("n_gold"))
    ps = conf.groupBy(*by, F.col("p").alias("c")).agg(F.sum("count").alias("n_pred"))
    per = gs.join(ps, on=by + ["c"], how="full_outer").join(tp, on=by + ["c"], how="left")
    tpc = F.coalesce(F.col("tp"), F.lit(0))
    denom = F.coalesce(F.col("n_gold"), F.lit(0)) + F.coalesce(F.col("n_pred"), F.lit(0))
    f1 = F.when(denom > 0, 2.0 * tpc / denom).otherwise(F.lit(0.0))
    return per.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def ce_loss(logits: str = "logits", gold: str = "gold"):
    """Per-row cross-entropy ``logsumexp(l) - l[gold]``."""
    return logsumexp(logits) - F.get(F.col(logits).cast("array<double>"), F.col(gold))


def batch_mean_loss(df: DataFrame, batch: str = "batch_id", logits: str = "logits",
                    gold: str = "gold") -> DataFrame:
    """Mean loss as the mean of batch means (not the row mean)."""
    per = df.groupBy(batch).agg(F.avg(ce_loss(logits, gold)).alias("batch_loss"))
    return per.agg(F.avg("batch_loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))


def batch_macro_f1(df: DataFrame, batch: str = "batch_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    per = macro_f1(df, gold, pred, by=[batch])
    return per.agg(F.avg("macro_f1").alias("mean_macro_f1"), F.count(F.lit(1)).alias("n_batches"))
