"""Operator 10, mixing sources to target weights: subset-sum budget fitting.

Targets: the sources in code-point order (null last) weigh 3, 1, 2, repeating,
and share ``share`` of all sizes; a target stops at ``most`` times its
source's size and the excess is shared again by weight until none is above.

Selection: whole documents, each the base number of times its source needs
(0 to ``most`` - 1) plus some once more. How many more of each exact length is
fitted on the source's length counts: first the same share of every length,
then the largest lengths that still fit, and the budget that remains by a
bounded-knapsack dynamic programme, so the sum meets the target to the word
wherever the lengths allow it. Which documents of a length: those with the
smallest seeded hash. The cut is found by hash buckets of a bounded expected
number of rows, so a length (or a source) with a third of all rows is not one
task.

Only the length counts of one source (at most as many rows as it has distinct
lengths) meet in one task.

Defined cases: a null text has size 0; size 0 is never taken; sources of size
0 have target 0; null sources are a source; rows that repeat id, source and
text are told apart by count; an empty table gives an empty one; extra columns
pass through ``mixed`` whatever their names. The same rows give the same mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import own_names, stage, word_count

WEIGHTS = (3, 1, 2)
BUCKET = 4096           # expected rows of a hash bucket
FINE = 20_000           # words: from here on the remaining budget is fitted exactly
OVER = 512              # sums so far above the budget are considered too
SMALL_PLAN = 200_000    # rows (one per source and length, under 16 MB) up to which the plan is broadcast


def targets_of(sources: list, sizes: list[int], share: float, most: int, weights=WEIGHTS) -> list[float]:
    """Target of every source; ``sources`` in any order."""
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, sources[i] or ""))
    weight = np.zeros(len(sources))
    for rank, i in enumerate(order):
        weight[i] = weights[rank % len(weights)]
    size = np.array(sizes, float)
    cap, target, fixed = most * size, np.zeros(len(size)), size <= 0
    budget = share * size.sum()
    while (~fixed).any():
        left = budget - target[fixed].sum()
        target[~fixed] = left * weight[~fixed] / weight[~fixed].sum()
        over = ~fixed & (target > cap)
        if not over.any():
            break
        target[over] = cap[over]
        fixed |= over
    return target.tolist()


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take (at most ``counts``) so that
    the sum of lengths comes as near to ``budget`` as can be."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    wish = counts * (budget / total)
    take = np.floor(wish).astype(np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.lexsort((-lengths, -(wish - take))):        # largest fractions first
        if left <= FINE:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= FINE:
            break
        more = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    reach, via, limit = 1, {}, (1 << (left + OVER + 1)) - 1
    for i in order:                                         # bounded knapsack over what is left
        size, fresh = int(lengths[i]), reach
        if size > left + OVER:
            continue
        for _ in range(int(counts[i] - take[i])):
            fresh = (fresh << size) & limit & ~reach
            if not fresh:
                break
            reach |= fresh
            for at in _bits(fresh):
                via[at] = i
            if reach >> left & 1:
                break
        if reach >> left & 1:
            break
    best = next(b for d in range(left + OVER + 1) for b in (left - d, left + d) if 0 <= b <= left + OVER and reach >> b & 1)
    while best:
        take[via[best]] += 1
        best -= int(lengths[via[best]])
    return take


def _bits(x: int) -> list[int]:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def plan(rows: DataFrame, share: float, most: int) -> DataFrame:
    """Per source and length ``source, size, n, source_size, target, base,
    extra`` from rows of ``source, size``."""
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))

    def aims(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(s) else s for s in pdf["source"]]
        return pdf.assign(target=targets_of(names, pdf["source_size"].tolist(), share, most))

    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aimed = sources.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(aims, "source string, source_size long, __all int, target double") \
        .select(F.col("source").alias("__s"), "source_size", "target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(most, int(target // whole)) if whole else 0
        extra = np.zeros(len(pdf), np.int64)
        real = size > 0
        if base < most:
            extra[real] = fit_lengths(size[real], n[real], round(target - base * whole))
        return pdf.assign(base=base, extra=extra)

    joined = counts.join(aimed, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return joined.groupBy("source").applyInPandas(
        fit, "source string, size long, n long, source_size long, target double, base long, extra long")


def cuts(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with the seeded hash ``cut`` up to which a document is taken
    once more, and of the ``tied`` rows at the cut itself how many
    (``tied_take``)."""
    some = plans.filter("extra > 0 and extra < n").select(F.col("source").alias("__s"), F.col("size").alias("__z"), "n", "extra")
    mine = F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
    bucket = F.floor((F.shiftrightunsigned("u", 11) / F.lit(float(1 << 53))) * F.ceil(F.col("n") / BUCKET))
    unsigned = F.col("u").bitwiseXOR(F.lit(-(1 << 63)))     # signed order of this is the unsigned order of u
    dealt = rows.join(some, mine).select("__s", "__z", "extra", bucket.alias("b"), unsigned.alias("k")) \
        .groupBy("__s", "__z", "extra", "b", "k").agg(F.count(F.lit(1)).alias("c"))
    per = dealt.groupBy("__s", "__z", "extra", "b").agg(F.sum("c").alias("c"))
    run = Window.partitionBy("__s", "__z").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    edge = per.withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0))) \
        .filter("before < extra and extra <= before + c").select("__s", "__z", "b", (F.col("extra") - F.col("before")).alias("more"))
    on = [F.col("x.__s").eqNullSafe(F.col("y.__s")), F.col("x.__z") == F.col("y.__z"), F.col("x.b") == F.col("y.b")]
    inner = dealt.alias("x").join(edge.alias("y"), on).select("x.__s", "x.__z", "x.k", "x.c", "y.more")
    run = Window.partitionBy("__s", "__z").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = inner.withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0))).filter("before < more and more <= before + c") \
        .select(F.col("__s").alias("s"), F.col("__z").alias("z"), F.col("k").alias("cut"), F.col("c").alias("tied"),
                (F.col("more") - F.col("before")).alias("tied_take"))
    return plans.join(found, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z") \
        .withColumn("cut", F.when(F.col("extra") == 0, F.lit(None).cast("long"))
                    .when(F.col("extra") == F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("cut")))


def _seeded(seed: int):
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text"), F.lit(seed))


def _copies(df: DataFrame, table: DataFrame, broadcast: bool) -> DataFrame:
    """``df`` (with ``__src, __size, __u``) and its ``__copies``, targets."""
    side = table.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("source_size").alias("__whole"),
                        F.col("target").alias("__target"), "base", "cut", "tied", "tied_take")
    side = side.select("__s", "__z", "__whole", "__target", *(F.col(c).alias(f"__{c}") for c in ("base", "cut", "tied", "tied_take")))
    on = F.col("__src").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    joined = df.join(F.broadcast(side) if broadcast else side, on)
    k = F.col("__u").bitwiseXOR(F.lit(-(1 << 63)))
    joined = joined.withColumn("__once", F.coalesce(k <= F.col("__cut"), F.lit(False))) \
        .withColumn("__tie", F.coalesce((k == F.col("__cut")) & (F.col("__tied") > F.col("__tied_take")), F.lit(False)))
    plain = joined.filter("not __tie")
    tied = joined.filter("__tie").withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__z").orderBy("__u"))) \
        .withColumn("__once", F.col("__rank") <= F.col("__tied_take")).drop("__rank")
    return plain.union(tied).withColumn("__copies", F.when(F.col("__size") > 0, F.col("__base") + F.col("__once").cast("long")).otherwise(F.lit(0)))


def _table(docs: DataFrame, share: float, most: int, seed: int):
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _seeded(seed).alias("u")), "mix")
    plans = stage(plan(rows, share, most), "mixplan")
    table = stage(cuts(rows, plans), "mixcuts")
    return rows, table, table.count() <= SMALL_PLAN


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 10) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``."""
    rows, table, small = _table(docs, share, most, seed)
    named = rows.select("doc_id", F.col("source").alias("__src"), F.col("size").alias("__size"), F.col("u").alias("__u"))
    return _copies(named, table, small).select(
        "doc_id", F.col("__size").alias("size"), F.col("__whole").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))


@own_names
def mixed(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 10) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    _, table, small = _table(docs, share, most, seed)
    named = docs.withColumns({"__src": F.col("source"), "__size": word_count(F.col("text")), "__u": _seeded(seed)})
    return _copies(named, table, small).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))) \
        .select(*docs.columns)
