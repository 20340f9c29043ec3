"""Operator 6, exact dedup: two-pass Bloom filtering, DataFrame functions only.

Pass one hashes every normalised text to ``HASHES`` places of a filter and
counts how often each place is hit (partly aggregated before the shuffle); the
places hit at least twice become a bitmap of at most ``MOST_BITS`` bits (32
MiB, the proven bound of what is broadcast). Pass two tests every row against
the bitmap: a row with a place hit only once cannot have a copy and passes
straight through; only the rest shuffle, by the text's SHA-256, and are
decided exactly. A fuller filter lets more rows into the exact path, it never
changes the result.

Defined cases: null counts as empty text; only A-Z are lower-cased; of equal
texts the row with the largest id stays (a null id is smaller than any other);
rows that repeat id and text count each and one of them stays; an empty table
gives an empty one; extra columns pass through ``exact_dedup`` whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, own_names, stage

HASHES = 2
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
PAGE = 1 << 15       # bits of one bitmap row, fixed by bitmap_construct_agg


def text_sha(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _places(sha: Column, bits: int) -> list[Column]:
    h = F.xxhash64(sha)
    width = bits.bit_length() - 1
    return [F.shiftrightunsigned(h, i * 32).bitwiseAND(F.lit((1 << min(width, 32)) - 1)) for i in range(HASHES)]


def repeated_places(shas: DataFrame, bits: int) -> DataFrame:
    """Pass one: bitmap pages ``(page, bitmap)`` of the places hit twice."""
    hits = shas.select(F.explode(F.array(*_places(F.col("sha"), bits))).alias("place")) \
               .groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hits.groupBy((F.col("place") / PAGE).cast("int").alias("page")) \
               .agg(F.bitmap_construct_agg(F.col("place") % PAGE).alias("bitmap"))


def may_repeat(df: DataFrame, sha: str, pages: DataFrame, bits: int, out: str) -> DataFrame:
    """Pass two: ``df`` with the flag ``out``; the pages are broadcast."""
    test = F.lit(True)
    for i, place in enumerate(_places(F.col(sha), bits)):
        own = F.broadcast(pages.select(F.col("page").alias(f"__page{i}"), F.col("bitmap").alias(f"__map{i}")))
        df = df.join(own, (place / PAGE).cast("int") == F.col(f"__page{i}"), "left")
        byte = F.substring(f"__map{i}", (F.floor((place % PAGE) / 8) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        bit = F.getbit(value.cast("long"), (place % 8).cast("int"))
        test = test & F.coalesce(bit == 1, F.lit(False))
    return df.withColumn(out, test).drop(*(f"__page{i}" for i in range(HASHES)), *(f"__map{i}" for i in range(HASHES)))


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, rows) - 1).bit_length()))


def decisions(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``."""
    rows = stage(docs.select("doc_id", text_sha(F.col("text")).alias("sha")), "sha")
    bits = filter_bits(rows.count())
    tested = may_repeat(rows, "sha", repeated_places(rows, bits), bits, "again")
    alone = tested.filter(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = tested.filter("again")
    group = stage(again.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    place = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy(F.lit(0)))
    decided = again.withColumn("place", place).join(group, "sha").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "sha")
    return alone.union(decided).withColumnRenamed("sha", "text_sha256")


@own_names
def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; only possibly repeated rows shuffle."""
    rows = stage(docs.select("doc_id", text_sha(F.col("text")).alias("sha")), "sha")
    bits = filter_bits(rows.count())
    pages = stage(repeated_places(rows, bits), "bloom")
    tested = may_repeat(docs.withColumn("__sha", text_sha(F.col("text"))), "__sha", pages, bits, "__again")
    group = may_repeat(rows, "sha", pages, bits, "again").filter("again") \
        .groupBy(F.col("sha").alias("__group")).agg(F.max("doc_id").alias("__keep"))
    winners = tested.filter("__again").join(group, F.col("__sha") == F.col("__group")) \
        .filter(F.col("doc_id").eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    return tested.filter(~F.col("__again")).select(*docs.columns).union(winners.select(*docs.columns))
