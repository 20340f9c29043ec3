"""Global row numbers, fixed-size batches, dynamic padding, seeded shuffles.

Global row numbers without a one-partition window: sort (range
partitioning, spread over all tasks), stage the sorted rows with the partition
and position of each in the shared checkpoint folder (so the two passes below read
identical rows and a lost executor does not re-sort; packed columns take a fraction
of the disk of a checkpoint), count rows per partition (one row per
partition), running sum of those counts (tiny), and add the in-partition
position taken from ``monotonically_increasing_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import pad_fixed
from tessera.functions.draws import draw_key
from tessera.operators.vocab import BOS_ID, EOS_ID, PAD_ID
from tessera.session import stage_table

PARTITION_TABLE_BROADCAST_LIMIT = 1_000_000


def row_numbers(df: DataFrame, order: list, out: str = "row_no") -> DataFrame:
    """0-based dense row number in ``order`` (a total order is expected)."""
    s = df.orderBy(*order).withColumn("__pid", F.spark_partition_id()) \
          .withColumn("__mid", F.monotonically_increasing_id())
    s = stage_table(s, "sorted")
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window below runs over a tiny table
    offs = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    if counts.count() <= PARTITION_TABLE_BROADCAST_LIMIT:
        offs = F.broadcast(offs)
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return s.join(offs, on="__pid").withColumn(out, (F.col("__off") + local).cast("long")) \
            .drop("__pid", "__mid", "__off")


def assign_batches(df: DataFrame, order: list, batch_size: int) -> DataFrame:
    """Contiguous batches of ``batch_size`` rows in ``order``: ``ceil(n/bs)``
    batches, the last one possibly short."""
    r = row_numbers(df, order)
    return r.withColumn("batch_id", F.floor(F.col("row_no") / batch_size).cast("long")) \
            .withColumn("pos_in_batch", F.pmod(F.col("row_no"), F.lit(batch_size)).cast("int"))


def padded_length(m: Column, multiple_of: int | None) -> Column:
    if not multiple_of:
        return m
    return (F.ceil(m / multiple_of) * multiple_of).cast("int")


def pad_batch(df: DataFrame, batch_col: str, arrays: dict[str, int], length_of: str,
              multiple_of: int | None = None) -> DataFrame:
    """Pad the given array columns (name → pad value) of every row to the
    longest ``length_of`` array of its batch, rounded up to a multiple of
    ``multiple_of`` (half-precision rule). Batches are bounded, so the
    window partition is bounded too."""
    w = Window.partitionBy(batch_col)
    m = F.max(F.size(length_of)).over(w)
    target = padded_length(m, multiple_of)
    out = df.withColumn("__len", target)
    for name, v in arrays.items():
        out = out.withColumn(name, pad_fixed(F.col(name), F.col("__len"), v))
    return out.withColumnRenamed("__len", "padded_len")


def prepare_batch(df: DataFrame, batch_col: str, tokens_col: str, max_length: int,
                  use_local_max_length: bool = True) -> DataFrame:
    """Retrieval inputs: batch-local length ``min(max(len)+2, max_length)``,
    tokens cut to fit, begin/end added, padded; attention mask, and the pool
    mask that skips the special tokens."""
    w = Window.partitionBy(batch_col)
    local = F.least(F.max(F.size(tokens_col)).over(w) + 2, F.lit(max_length))
    L = local if use_local_max_length else F.lit(max_length)
    d = df.withColumn("__L", L.cast("int"))
    body = F.slice(F.col(tokens_col), 1, F.greatest(F.col("__L") - 2, F.lit(0)))
    ids = F.concat(F.array(F.lit(BOS_ID)), body, F.array(F.lit(EOS_ID)))
    d = d.withColumn("__ids", ids)
    n = F.size("__ids")
    pad = F.greatest(F.col("__L") - n, F.lit(0))
    return d.select(
        *[c for c in df.columns if c != tokens_col], F.col("__L").alias("max_length"),
        pad_fixed(F.col("__ids"), F.col("__L"), PAD_ID).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), n - 2),
                 F.array_repeat(F.lit(0), pad + 1)).alias("pool_mask"))


def len_stats(df: DataFrame, batch_col: str, tokens_col: str, max_length: int) -> DataFrame:
    """Per batch: longest row, and the local length ``min(max+2, max_length)``.
    ``tokens_col`` holds the tokens or their number."""
    size = F.size(tokens_col) if isinstance(df.schema[tokens_col].dataType, T.ArrayType) else F.col(tokens_col)
    return df.groupBy(batch_col).agg(
        F.max(size).alias("max_tokens"),
        F.least(F.max(size) + 2, F.lit(max_length)).alias("local_length"),
        F.count(F.lit(1)).alias("n_rows"))


def shuffle_key(seed: int, epoch: Column | int, *ids) -> Column:
    return F.md5(draw_key(F.lit(seed), epoch if isinstance(epoch, Column) else F.lit(epoch), *ids))


def seeded_shuffle(df: DataFrame, seed: int, epoch: int, id_cols: list[str]) -> DataFrame:
    """Reproducible shuffle: position in the order of ``md5(seed:epoch:id)``;
    range-partitioned sort, no single-node step."""
    k = shuffle_key(seed, epoch, *[F.col(c) for c in id_cols])
    r = row_numbers(df.withColumn("__k", k), [F.col("__k")] + [F.col(c) for c in id_cols], out="shuffle_pos")
    return r.drop("__k")
