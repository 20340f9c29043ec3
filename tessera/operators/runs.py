"""Run bookkeeping: checkpoint selection, run matrices, pending runs, file
resolution, best-checkpoint / early-stopping logic over evaluation
histories, epoch statistics and dev summaries.

These tables are small (runs, checkpoints, evaluations), but they are still
DataFrame plans so that they join with the large result tables without a
trip through the driver. Running scans per run are two-level (block
maxima, then bounded in-block windows), so a run with a huge history is
never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_step(name) -> "F.Column":
    """Numeric suffix after the first ``-`` (null when not a number)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.split_part(c, F.lit("-"), F.lit(2)).try_cast("int")


def select_checkpoints(df: DataFrame, lo: int, hi: int, name: str = "name") -> DataFrame:
    """Names containing ``checkpoint`` whose numeric suffix lies in the
    inclusive range ``[lo, hi]``, with the suffix as ``step``."""
    s = df.withColumn("step", checkpoint_step(name))
    return s.filter(F.col(name).contains("checkpoint") & F.col("step").between(lo, hi))


def run_matrix(checkpoints: DataFrame, train_langs: list[str], n_seeds: int, base_seed: int,
               base_model: str, name: str = "name") -> DataFrame:
    """Checkpoints × train languages × seeds. The language list and seed
    count are job parameters, so they are exploded literals (no join);
    ``checkpoint-0`` (exact match) stands for the base model."""
    langs = F.array(*[F.lit(x) for x in train_langs])
    r = checkpoints.select("*", F.explode(langs).alias("train_lang"),
                           F.explode(F.sequence(F.lit(base_seed), F.lit(base_seed + n_seeds - 1))).alias("seed"))
    return r.withColumn("model_ref", F.when(F.col(name) == "checkpoint-0", F.lit(base_model))
                        .otherwise(F.col(name)))


def run_name(parts: list, sep: str = "_") -> "F.Column":
    """Run name from parameter columns / literals (null parts are skipped)."""
    return F.concat_ws(sep, *[p if not isinstance(p, str) else F.col(p) for p in parts])


def training_run_name(base, train_file, loss, use_lm, use_contrastive, use_tlm, train_cls, weight, use_cosine,
                      temperature, use_smoothing, reset_positions) -> "F.Column":
    """Run name of a continued training from its parameters (columns): the
    base name, the third last part of the training file's path, the loss, and
    one suffix per setting that departs from the default. The pooling and
    weight suffixes belong to the loss ``TCM`` alone."""
    def when(flag, text):
        return F.when(flag, text if isinstance(text, Column) else F.lit(text)).otherwise(F.lit(""))
    contrast = F.concat(F.when(train_cls, F.lit("_cls")).otherwise(F.lit("_pool")),
                        F.lit("_weight_"), weight.cast("string"))
    return F.concat(
        base, F.lit("_"), F.element_at(F.split(train_file, "/"), -3), F.lit("_"), loss,
        when(train_file.contains("with"), "_with_latn"),
        when(loss == "TCM", F.when(use_contrastive, contrast).otherwise(F.lit("_no_contrast"))),
        when(~use_lm, "_no_lm"), when(use_tlm, "_tlm"),
        when(use_cosine, F.concat(F.lit("_cosine_"), temperature.cast("string"))),
        when(use_smoothing, "_smoothed"), when(reset_positions, "_reset_pos"))


def pending_runs(runs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose output does not exist yet (left-anti on the run key)."""
    return runs.join(done.select(*keys), on=keys, how="left_anti")


def resolve_parallel(langs: DataFrame, files: DataFrame, task: str, tgt: str,
                     pivot: str = "eng_Latn") -> DataFrame:
    """Source/target file names per source language; the target file is the
    source's own pair file when the target is the pivot language, else the
    target's pair file. Same-language pairs are skipped; a language whose
    files are missing is dropped (left-semi against the listing)."""
    src_file = F.format_string(f"{task}.%s-{pivot}.%s", F.col("lang"), F.col("lang"))
    tgt_file = (F.format_string(f"{task}.%s-{pivot}.{pivot}", F.col("lang")) if tgt == pivot
                else F.lit(f"{task}.{tgt}-{pivot}.{tgt}"))
    r = langs.filter(F.col("lang") != F.lit(tgt)).select(
        F.col("lang").alias("src_lang"), F.lit(tgt).alias("tgt_lang"), src_file.alias("src_file"),
        tgt_file.alias("tgt_file"))
    f = files.select(F.col("file_name")).distinct()
    r = r.join(f.withColumnRenamed("file_name", "src_file"), on="src_file", how="left_semi")
    return r.join(f.withColumnRenamed("file_name", "tgt_file"), on="tgt_file", how="left_semi")


def read_langs(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Language list file ``lang<TAB>flag``: only the first column is used."""
    return lines.select(F.split_part(F.col(text_col), F.lit("\t"), F.lit(1)).alias("lang"))


def best_run(history: DataFrame, run: str, order: str, score: str, item: str,
             start: float = 0.0, default=None) -> DataFrame:
    """Highest score per run; strictly greater wins, so the first on ties;
    nothing beats the start value (0 for checkpoints, -1 for epochs). A run
    without such a score keeps ``default`` and the start value."""
    wins = F.col(score) > F.lit(start)
    return history.groupBy(run).agg(
        F.coalesce(F.max_by(F.when(wins, F.col(item)), F.when(wins, F.struct(F.col(score), -F.col(order)))),
                   F.lit(default).cast(history.schema[item].dataType)).alias(f"best_{item}"),
        F.coalesce(F.max(F.when(wins, F.col(score))), F.lit(start)).alias(f"best_{score}"))


BLOCK = 65536


def running_max(df: DataFrame, part: str, order: str, value, out: str, inclusive: bool = True,
                block: int = BLOCK) -> DataFrame:
    """Running maximum of ``value`` per ``part`` in ``order`` (a dense
    1-based sequence number), two-level so that no window spans a whole
    partition key: per-block maxima → prefix over the (small) block table →
    in-block window bounded by ``block`` rows."""
    v = value if not isinstance(value, str) else F.col(value)
    d = df.withColumn("__v", v).withColumn("__b", F.floor((F.col(order) - 1) / block))
    blocks = d.groupBy(part, "__b").agg(F.max("__v").alias("__bm"))
    wb = Window.partitionBy(part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(part, "__b", F.max("__bm").over(wb).alias("__prev"))
    wi = Window.partitionBy(part, "__b").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    j = d.join(blocks, on=[part, "__b"], how="left")
    inner = F.max("__v").over(wi)
    res = F.when(F.col("__prev").isNull(), inner).when(inner.isNull(), F.col("__prev")) \
           .otherwise(F.greatest(F.col("__prev"), inner))
    return j.withColumn(out, res).drop("__v", "__b", "__prev")


def sequence_numbers(df: DataFrame, part: str, order: list, out: str = "eval_no") -> DataFrame:
    """1-based position within ``part`` in ``order`` without a per-key
    window: global row numbers (range-partitioned sort) minus each key's
    first row number (a partial aggregate over keys, joined back)."""
    from tessera.operators.batching import row_numbers
    r = row_numbers(df, [F.col(part)] + list(order), out="__rn")
    first = r.groupBy(part).agg(F.min("__rn").alias("__first"))
    return r.join(first, on=part).withColumn(out, (F.col("__rn") - F.col("__first") + 1)) \
            .drop("__rn", "__first")


def improvement_flags(history: DataFrame, run: str, order: str, score: str, start: float) -> DataFrame:
    h = running_max(history, run, order, score, "__pm", inclusive=False)
    best_before = F.greatest(F.coalesce(F.col("__pm"), F.lit(start)), F.lit(start))
    return h.withColumn("best_before", best_before).drop("__pm") \
            .withColumn("improved", F.col(score) > F.col("best_before"))


def early_stop(history: DataFrame, patience: int, run: str = "run", order: str = "eval_no",
               score: str = "f1", start: float = 0.0) -> DataFrame:
    """Per run: the evaluation at which training stops — the first one where
    the count of consecutive non-improving evaluations exceeds ``patience``
    (null when it never happens or ``patience <= 0``). Misses at an
    evaluation = its number minus the number of the last improving one."""
    h = improvement_flags(history, run, order, score, start)
    h = running_max(h, run, order, F.when(F.col("improved"), F.col(order)), "__last")
    h = h.withColumn("misses", F.col(order) - F.coalesce(F.col("__last"), F.lit(0)))
    stops = h.filter((F.lit(patience) > 0) & (F.col("misses") > patience)) \
             .groupBy(run).agg(F.min(order).alias("stop_at"))
    runs = history.select(run).distinct()
    return runs.join(stops, on=run, how="left")


def running_best(history: DataFrame, run: str = "run", order: str = "epoch", score: str = "f1",
                 start: float = -1.0) -> DataFrame:
    """Running best with strict improvement (start value -1)."""
    h = improvement_flags(history, run, order, score, start)
    return h.withColumn("best_so_far", F.greatest(F.col("best_before"), F.col(score)))


def epoch_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
                                 F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def dev_summary(results: DataFrame, run: str, step: str, metrics: list[str], best: DataFrame,
                several: bool = True) -> DataFrame:
    """Long ``(run, key, value)`` table: metric names prefixed by the step
    when several checkpoints were evaluated, plus one line for every column
    of ``best`` after the run (best checkpoint, best score)."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v"))
                                for m in metrics]))
    long = results.select(run, step, stack.alias("kv"))
    key = F.concat_ws("_", F.col(step).cast("string"), F.col("kv.m")) if several else F.col("kv.m")
    rows = long.select(run, key.alias("key"), F.col("kv.v").alias("value"))
    lines = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                                for c in best.columns if c != run]))
    return rows.unionByName(best.select(run, lines.alias("kv")).select(run, "kv.key", "kv.value"))
