"""Greedy packing of sentences into fragments, by jumps and composed blocks.

A fragment takes tokens while their piece counts fit a budget. With prefix sums
the end of a fragment is one search, so a sentence costs a search per fragment,
done for all sentences of an Arrow batch at once; only the piece counts go to
Python, the rest of a row stays where it is.

A sentence is packed in blocks of its lines, so one without an end is not one
row. What a block does to the packing is a small function: entered with an open
fragment of ``c`` pieces, it leaves with so many pieces and tokens in its last
fragment and has opened so many fragments. These functions are made for the
blocks of sentences that have several, composed in order, and tell every block
the state it is entered in.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.operators.tag_arrays import is_array, pack_arrays
from tessera.session import stage_table

BLOCK = 1 << 16          # lines


def _jumps(prefix: np.ndarray, budget: int, end: np.ndarray) -> np.ndarray:
    """For every token the first token that a fragment starting here cannot
    take; ``prefix`` may run over many sentences, ``end`` bounds each."""
    at = np.arange(len(end))
    return np.minimum(np.maximum(at + 1, np.searchsorted(prefix, prefix[at] + budget, side="right") - 1), end)


def leave(sizes: np.ndarray, budget: int):
    """The function of one block as arrays over the entry count ``0..budget``
    (and one more for a larger one): pieces and tokens in the last fragment at
    the end, and fragments opened; without an opened one the pieces are added to
    those at entry."""
    size = len(sizes)
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    step = _jumps(prefix, budget, np.full(size, size))
    last, opened = np.where(step < size, step, np.arange(size)), (step < size).astype(np.int64)
    while True:
        more = opened[last]
        if not more.any():
            break
        opened, last = opened + more, last[last]
    first = np.searchsorted(prefix, budget - np.arange(budget + 2), side="right") - 1
    first = np.maximum(first, 0)
    inside = first < size
    start = np.minimum(first, size - 1)
    return (np.where(inside, prefix[-1] - prefix[last[start]], prefix[-1]), np.where(inside, size - last[start], size),
            np.where(inside, 1 + opened[start], 0))


def _leaving(budget: int):
    @arrow_udf("struct<pieces:array<long>,tokens:array<long>,opened:array<long>>")
    def of(sizes: pa.Array) -> pa.Array:
        rows = [leave(np.asarray(s, np.int64), budget) for s in sizes.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(3)], ["pieces", "tokens", "opened"])
    return of


def _entered(budget: int):
    """Composes the blocks of a sentence: the state each block is entered in."""
    @arrow_udf("array<struct<block:long,pieces:long,frag:int,tokens:long>>")
    def of(blocks: pa.Array) -> pa.Array:
        out = []
        for sentence in blocks.to_pylist():
            pieces, frag, tokens, states = budget + 1, -1, 0, []       # the first token opens fragment 0
            for k, block in enumerate(sentence):
                if k:
                    states.append({"block": block["block"], "pieces": pieces, "frag": frag, "tokens": tokens})
                at = min(pieces, budget + 1)
                does = {n: block["does"][n][at] for n in ("pieces", "tokens", "opened")}
                if does["opened"]:
                    pieces, tokens, frag = does["pieces"], does["tokens"], frag + does["opened"]
                else:
                    pieces, tokens = pieces + does["pieces"], tokens + does["tokens"]
            out.append(states)
        return pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("pieces", pa.int64()), ("frag", pa.int32()), ("tokens", pa.int64())])))
    return of


def fragment_positions(sizes: pa.Array, pieces: np.ndarray, frag: np.ndarray, tokens: np.ndarray, budget: int) -> pa.Array:
    """``(frag, pos)`` of every token of every row; a row is entered with an
    open fragment ``frag`` of ``pieces`` pieces and ``tokens`` tokens, or none
    (``tokens`` 0)."""
    sizes = pa.concat_arrays([sizes]) if sizes.offset else sizes
    offsets = sizes.offsets.to_numpy().astype(np.int64)
    flat = sizes.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    prefix = np.concatenate([[0], np.cumsum(flat)])
    begin, end = offsets[:-1], offsets[1:]
    stop = np.repeat(end, end - begin)
    step = _jumps(prefix, budget, stop)
    # where the open fragment of the row ends, then fragment by fragment in all rows at once
    taken = np.maximum(np.searchsorted(prefix, prefix[begin] + budget - pieces, side="right") - 1, begin)
    at = np.where(tokens > 0, np.minimum(taken, end), begin)
    starts = np.zeros(len(flat), bool)
    live = at[at < end]
    while len(live):
        starts[live] = True
        live = step[live][step[live] < stop[live]]
    row = np.repeat(np.arange(len(begin)), end - begin)
    where = np.arange(len(flat))
    count = np.cumsum(starts)
    before = np.concatenate([[0], count])[begin]
    opened = count - before[row]
    since = np.maximum.accumulate(np.where(starts, where, -1)) if len(flat) else where
    continued = opened == 0
    first = np.where(tokens > 0, 0, 1)
    number = frag[row] + opened - first[row]
    pos = np.where(continued, tokens[row] + where - begin[row], where - since)
    items = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(pos.astype(np.int32))], ["frag", "pos"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)


def _positions(budget: int):
    @arrow_udf("array<struct<frag:int,pos:int>>")
    def of(sizes: pa.Array, pieces: pa.Array, frag: pa.Array, tokens: pa.Array) -> pa.Array:
        return fragment_positions(sizes, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pieces, frag, tokens)), budget)
    return of


def _same(a: DataFrame, b: DataFrame, keys: list[str], right: str):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{right}{i}"]) for i, k in enumerate(keys)])


def pack_fragments(df: DataFrame, sent_keys: list[str], budget: int, order_col: str = "line_no",
                   n_col: str = "n_pieces", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Greedy packing: running piece count per sentence; when adding the next
    token would exceed ``budget`` a new fragment starts and the counter
    restarts at that token's size. Adds ``frag`` and ``pos`` (0-based). A row
    holds the tokens of a sentence within ``block`` lines, so its size is
    bounded whatever the sentence is. With arrays (a file per row, its sentences
    runs of equal keys) ``frag`` and ``pos`` are arrays beside the others."""
    if is_array(df, n_col):
        keys = [k for k in sent_keys if is_array(df, k)]
        rest = [*sent_keys, order_col, n_col, *(carry or [])]
        return pack_arrays(df, rest, keys, n_col, budget, fragment_positions)
    carry = list(carry or [])
    token = F.struct(F.col(order_col).alias("o"), F.col(n_col).cast("long").alias("n"), *[F.col(c) for c in carry])
    rows = df.groupBy(*sent_keys, F.floor(F.col(order_col) / block).alias("__block")).agg(F.array_sort(F.collect_list(token)).alias("__rows"))
    rows = stage_table(rows.withColumn("__sizes", F.transform("__rows", lambda r: r["n"])), "sentence-blocks")

    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(sent_keys)]
    several = rows.groupBy(*sent_keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*named)
    long_rows = rows.join(several, _same(rows, several, sent_keys, "__k"), "left_semi")
    does = long_rows.select(*sent_keys, F.struct(F.col("__block").alias("block"), _leaving(budget)("__sizes").alias("does")).alias("b"))
    chained = does.groupBy(*sent_keys).agg(F.array_sort(F.collect_list("b")).alias("bs")) \
                  .select(*named, F.explode(_entered(budget)("bs")).alias("s"))
    states = chained.select(*[f"__k{i}" for i in range(len(sent_keys))], F.col("s.block").alias("__at"), "s.pieces", "s.frag", "s.tokens")

    entered = rows.join(states, _same(rows, states, sent_keys, "__k") & (rows["__block"] == states["__at"]), "left")
    state = [F.coalesce(F.col(c), F.lit(0)) for c in ("pieces", "frag", "tokens")]
    packed = entered.select(*sent_keys, "__rows", _positions(budget)("__sizes", *state).alias("__fp"))
    z = packed.select(*sent_keys, F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__fp").alias("f"))).alias("z"))
    return z.select(*sent_keys, F.col("z.r.o").alias(order_col), F.col("z.r.n").cast(df.schema[n_col].dataType).alias(n_col),
                    *[F.col(f"z.r.{c}").alias(c) for c in carry], F.col("z.f.frag").alias("frag"), F.col("z.f.pos").alias("pos"))
