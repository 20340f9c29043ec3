"""Operator 7, document fingerprints: consistent weighted sampling, DataFrame
functions only.

A text is the set of its lower-cased words, each weighing its count. Weights
are cut into parts of at most ``PART`` (word, part number), which changes
neither the sum of minima nor that of maxima. Every part is dealt to one of
``SLOTS`` slots by a hash; two gamma(2, 1) draws and a uniform one, from other
hashes of the part, give its quantised weight and its sampling value, and the
part with the smallest value in a slot is the slot's sample, identified by the
part and the quantised weight. Two texts agree in a slot with the probability
of the generalised Jaccard similarity of what was dealt to it; likeness is the
share of equal slots among those that either text fills.

Counts are made inside the row (bounded by the text); the draws and the minima
per slot run over exploded parts, in the same stage as the join that brings a
text together with its successor's beginning.

The fingerprint is the filled slots in order, two hex digits for the slot and
four for the sample.

Defined cases: null is the empty text; texts without a word have an empty
fingerprint, which is like another empty one (1) and unlike any other (0);
rows with the same id and text count as one document in the order and are each
returned; ties in id are ordered by text hash; a null id sorts last; a single
document is its own next; an empty table gives an empty one; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.llm.common import WORD_BREAKS, stage

SLOTS, PART = 64, 4
LOW = -(1 << 63)


def _uniform(x: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFF)) + F.lit(0.5)) / F.lit(65536.0)


def weighted_words(text: Column) -> Column:
    """Array of ``(t, w)``: hash and count of every word of the text."""
    words = F.array_remove(F.split(F.lower(text), WORD_BREAKS, -1), "")
    terms = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def of_terms(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))

        def weigh(at: Column) -> Column:
            return F.transform(at, lambda i, j: F.struct(F.get(h, i).alias("t"), (F.coalesce(F.get(at, j + 1), F.size(h)) - i).alias("w")))
        return F.when(F.size(h) > 0, let(starts, weigh))

    return let(terms, of_terms)


def signatures(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, own, other``: the signatures (arrays of ``slot * 65536 +
    sample``, ascending) of the columns ``text`` and ``edited``. ``keys`` are
    distinct; if the rows are partitioned by them nothing shuffles."""
    sides = texts.select(*keys, F.stack(F.lit(2), F.lit(0), F.col("text"), F.lit(1), F.col("edited")).alias("side", "text"))
    parts = sides.select(*keys, "side", F.inline(weighted_words(F.col("text")))) \
        .select(*keys, "side", "t", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / PART).cast("int"))).alias("j")) \
        .select(*keys, "side", F.ln(F.least(F.lit(PART), F.col("w") - PART * F.col("j")).cast("double")).alias("lw"),
                F.xxhash64("t", "j", F.lit(1)).alias("x"), F.xxhash64("t", "j", F.lit(2)).alias("y"))
    x, y = F.col("x"), F.col("y")
    r, beta = F.col("r"), _uniform(y, 0)
    drawn = parts.withColumn("r", -F.ln(_uniform(x, 0) * _uniform(x, 16))) \
        .withColumn("level", F.floor(F.col("lw") / r + beta))
    value = F.ln(-F.ln(_uniform(x, 32) * _uniform(x, 48))) - r * (F.col("level") - beta + F.lit(1.0))
    fixed = F.floor((value + F.lit(96.0)) * F.lit(float(1 << 25))).cast("long")
    sample = F.shiftleft(fixed, 16).bitwiseOR(F.xxhash64(x, "level").bitwiseAND(F.lit(0xFFFF)))
    slot = F.shiftrightunsigned(y, 16).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    least = drawn.select(*keys, "side", slot.alias("slot"), sample.alias("sample")) \
        .groupBy(*keys, "side", "slot").agg(F.min("sample").alias("sample"))
    cell = F.shiftleft(F.col("slot"), 16).bitwiseOR(F.col("sample").bitwiseAND(F.lit(0xFFFF)).cast("int"))
    return least.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == i, cell))).alias(name)
                                      for i, name in enumerate(("own", "other"))])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either signature fills."""
    slots = [F.transform(x, lambda s: F.shiftright(s, 16)) for x in (a, b)]
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(*slots))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either).cast("double")


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda s: F.lower(F.lpad(F.hex(s), 6, "0"))), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """The next key of every distinct ``(kd, th)`` in descending order, the
    first after the last. Range partitions are walked on their own; one row
    per partition joins their ends."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(keys.repartitionByRange(parts, F.desc("kd"), F.asc("th")).withColumn("part", F.spark_partition_id()), "order")
    order = [F.desc("kd"), F.asc("th")]
    inside = Window.partitionBy("part").orderBy(*order)
    ahead = dealt.withColumn("nkd", F.lead("kd").over(inside)).withColumn("nth", F.lead("th").over(inside))
    heads = dealt.groupBy("part").agg(F.max(F.struct("kd", (F.lit(-1) - F.col("th")).alias("minus"))).alias("head"))
    rank = Window.orderBy("part")                           # one row per partition
    ends = heads.withColumn("up", F.lead("head").over(rank)) \
        .withColumn("up", F.coalesce("up", F.first("head").over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))) \
        .select("part", F.col("up.kd").alias("ekd"), (F.lit(-1) - F.col("up.minus")).alias("eth"))
    last = F.col("nth").isNull()
    return ahead.join(F.broadcast(ends), "part").select(
        "kd", "th", "n", F.when(last, F.col("ekd")).otherwise(F.col("nkd")).alias("nkd"),
        F.when(last, F.col("eth")).otherwise(F.col("nth")).alias("nth"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(LOW)).alias("kd"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = keyed.select("kd", "th", F.char_length("text").alias("n")).groupBy("kd", "th").agg(F.max("n").alias("n"))
    after = stage(next_keys(keys), "next")
    wanted = after.select(F.col("kd").alias("akd"), F.col("th").alias("ath"), F.col("nkd").alias("kd"), F.col("nth").alias("th"),
                          F.floor(F.col("n") / 3).cast("int").alias("need"))
    heads = keyed.join(wanted, ["kd", "th"]).select(F.col("akd").alias("kd"), F.col("ath").alias("th"), F.col("kd").alias("nkd"),
                                                     F.col("th").alias("nth"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head")) \
        .dropDuplicates(["kd", "th"])
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    both = keyed.join(heads, ["kd", "th"]).select("kd", "th", "nkd", "nth", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    lone = both.groupBy("kd", "th").agg(F.first("text").alias("text"), F.first("edited").alias("edited"))
    none = F.array().cast("array<int>")
    signed = stage(both.select("kd", "th", "nkd", "nth", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
                   .join(signatures(lone, ["kd", "th"]), ["kd", "th"], "left")
                   .withColumns({c: F.coalesce(c, none) for c in ("own", "other")}), "signatures")
    following = signed.select(F.col("kd").alias("nkd"), F.col("th").alias("nth"), F.col("own").alias("next")).dropDuplicates(["nkd", "nth"])
    return signed.join(following, ["nkd", "nth"]).select(
        F.nullif(F.col("kd"), F.lit(LOW)).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
