"""Operator 4, sharding: sampled splitters, DataFrame functions only.

Law ``bytes``: shards hold nearly equal sizes. Rows are ordered by the hash of
their text, then by a hash of id and text. A size-weighted sample of keys (a
fixed expected number, whatever the input) gives quantile boundaries; every
row finds its range by a broadcast table of ``SLOTS`` rows; exact sums per
range show overfull ranges, which are subdivided by quantiles of their own
rows until none that can be divided is left. Running sums inside the ranges
plus the ranges' offsets then place every row at its exact byte position,
which names the shard, and its slot in it.

Equal texts are neighbours in that order and stay in one shard unless their
group is larger than ``WHOLE`` of a shard; larger groups are divided by id, so
a group with a third of all rows is spread over many ranges and tasks.

Defined cases: a null text has size 16 and CRC 0; rows that repeat id and text
get slots of their own; fewer rows than shards leave shards empty; an empty
table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

PER_SHARD = 32          # ranges per shard
SAMPLES = 4             # expected sampled keys per range
SLOTS = 4096            # slots of the boundary table: the leading 12 bits of the key
WHOLE = 0.01            # of a shard: a group of equal texts up to this size is not divided
LOW = -(1 << 63)
OVERFULL = 3


def _slot(k1: Column) -> Column:
    return (F.shiftright(k1, 52) + SLOTS // 2).cast("int")


def _weighted_splitters(rows: DataFrame, step: Column, need: Column) -> DataFrame:
    """Quantiles ``(k1, k2)`` of the sample: rows are drawn with a chance
    proportional to their size, and each stands for ``need`` bytes at least."""
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < F.col("size") / need).select("k1", "k2", F.greatest(F.col("size").cast("double"), need).alias("w"))
    # bounded: the expected number of sampled rows is a parameter
    before = F.sum("w").over(Window.orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1))
    at = F.floor(F.coalesce(before, F.lit(0.0)) / step)
    cuts = sample.withColumn("q", at).withColumn("up", F.lag("q").over(Window.orderBy("k1", "k2"))) \
        .filter("q > up").select("k1", "k2")
    # a boundary inside a group moves to the group's start, unless several fall into it
    first = F.row_number().over(Window.partitionBy("k1").orderBy("k2"))
    return cuts.withColumn("n", first).select("k1", F.when(F.col("n") == 1, F.lit(LOW)).otherwise(F.col("k2")).alias("k2")).distinct()


def with_range(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """``rows`` with ``range``: the number of splitters up to the row's key."""
    spark = rows.sparkSession
    lists = splitters.groupBy(_slot(F.col("k1")).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("cuts"))
    table = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(lists, "slot", "left") \
        .withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<k1:bigint,k2:bigint>>")))
    base = F.coalesce(F.sum(F.size("cuts")).over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = table.select("slot", "cuts", base.cast("int").alias("base"))
    key = F.struct("k1", "k2")
    return rows.join(F.broadcast(table), _slot(F.col("k1")) == F.col("slot")) \
        .withColumn("range", F.col("base") + F.size(F.filter("cuts", lambda c: c <= key))).drop("slot", "cuts", "base")


def _refined(rows: DataFrame, splitters: DataFrame, bound: Column) -> DataFrame | None:
    """Splitters with quantiles of the overfull ranges added; None if no range
    that can be divided is overfull."""
    part = with_range(rows, splitters)
    eighths = F.array(*[F.lit(i / 8) for i in range(1, 8)])
    wide = part.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2"),
        F.percentile_approx("k1", eighths, F.lit(1000)).alias("q1"), F.percentile_approx("k2", eighths, F.lit(1000)).alias("q2")) \
        .filter((F.col("bytes") > bound) & ((F.col("a1") < F.col("b1")) | (F.col("a2") < F.col("b2"))))
    one = F.col("a1") == F.col("b1")
    more = wide.select("a1", one.alias("one"), F.explode(F.when(one, F.col("q2")).otherwise(F.col("q1"))).alias("q")) \
        .select(F.when(F.col("one"), F.col("a1")).otherwise(F.col("q")).alias("k1"),
                F.when(F.col("one"), F.col("q")).otherwise(F.lit(LOW)).alias("k2"))
    more = stage(more.distinct(), "splitters")
    return None if more.isEmpty() else stage(splitters.union(more).distinct(), "splitters")


def shard_by_bytes(docs: DataFrame, shards: int = 40, rounds: int = 3) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per
    row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                             F.xxhash64(text).alias("k1"), F.xxhash64("doc_id", text).alias("k2")), "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * PER_SHARD
    step, need = F.lit(total / ranges), F.lit(total / (ranges * SAMPLES))
    splitters = stage(_weighted_splitters(rows, step, need), "splitters")
    for _ in range(rounds):
        more = _refined(rows, splitters, F.lit(OVERFULL * total / ranges))
        if more is None:
            break
        splitters = more
    part = with_range(rows, splitters)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    offsets = sums.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("range").orderBy("k1", "k2", "doc_id", "size")
    placed = part.withColumn("at", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")) \
        .withColumn("n", F.row_number().over(inside))
    group = Window.partitionBy("range", "k1")
    placed = placed.withColumn("whole", F.sum("size").over(group) <= F.lit(WHOLE * total / shards)) \
        .withColumn("start", F.min("at").over(group))
    placed = placed.join(F.broadcast(offsets), "range")     # one row per range, a parameter
    at = F.col("b0") + F.when(F.col("whole"), F.col("start")).otherwise(F.col("at"))
    shard = F.least(F.lit(shards - 1), F.floor(at * F.lit(shards) / F.lit(float(max(1, total))))).cast("int")
    placed = stage(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("n") - 1).alias("position")), "shards")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
