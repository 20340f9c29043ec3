"""Encoded pair rows: begin/end tokens, masks, TLM concatenation, position
ids and MLM masking — all array expressions on one row (narrow stages).

Randomness is md5-keyed (:mod:`tessera.functions.draws`) by
``(seed, row key, side, position)``, so a re-executed task after an
executor loss draws exactly the same masks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import pad_fixed
from tessera.functions.draws import coin, draw_key, uniforms
from tessera.operators.tag_arrays import flat, lists
from tessera.operators.vocab import BOS_ID, EOS_ID, MASK_ID, PAD_ID

ENC_SUFFIXES = ("input_ids", "attention_mask", "special_tokens_mask", "token_type_ids")


def add_special(ids: Column, max_len: int) -> Column:
    """``[bos] + ids[:max_len-2] + [eos]`` (truncation keeps room for both)."""
    return F.concat(F.array(F.lit(BOS_ID)), F.slice(ids, 1, max_len - 2), F.array(F.lit(EOS_ID)))


def encode_side(ids: Column, max_len: int, suffix: str) -> list[Column]:
    """The four arrays of one side; type ids are all zero, the special mask
    marks the begin and end token. Built from sizes only (no per-element
    lambda re-reading the concatenated array)."""
    n_body = F.least(F.size(ids), F.lit(max_len - 2))
    n = n_body + 2
    return [add_special(ids, max_len).alias(f"input_ids_{suffix}"),
            F.array_repeat(F.lit(1), n).alias(f"attention_mask_{suffix}"),
            F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n_body), F.array(F.lit(1)))
            .alias(f"special_tokens_mask_{suffix}"),
            F.array_repeat(F.lit(0), n).alias(f"token_type_ids_{suffix}")]


def pair_encode(df: DataFrame, keys: list[str], ids_1: Column, ids_2: Column, max_len: int) -> DataFrame:
    """Eight parallel arrays per pair; the text columns are pruned."""
    return df.select(*keys, *encode_side(ids_1, max_len, "1"), *encode_side(ids_2, max_len, "2"))


def as_text(text: Column) -> Column:
    """Text as the topic tasks read it: a missing value is the text ``nan``."""
    return F.coalesce(text, F.lit("nan"))


def topic_encode(ids: Column, length: int) -> list[Column]:
    """Model inputs of a topic row, exactly ``length`` long: special tokens,
    truncation, padding on the right, and the attention mask."""
    full = add_special(ids, length)
    return [pad_fixed(full, length, PAD_ID).alias(f"input_ids_{length}"),
            pad_fixed(F.array_repeat(F.lit(1), F.size(full)), length, 0).alias(f"attention_mask_{length}")]


def tlm_concat(df: DataFrame, keys: list[str], max_len: int, seed: int,
               reset_position_ids: bool = False) -> DataFrame:
    """Translation-LM input: per pair a coin picks the order; the second
    sequence loses its begin token unless positions are reset; the result is
    cut to ``max_len``. Applied alike to the four arrays."""
    order = coin(F.lit(seed), *[F.col(k) for k in keys], F.lit("tlm"))
    start = 1 if reset_position_ids else 2  # 1-based slice start of the second part
    out = [*keys, order.alias("tlm_order")]
    for name in ENC_SUFFIXES:
        a, b = F.col(f"{name}_1"), F.col(f"{name}_2")
        first = F.when(order == 1, a).otherwise(b)
        second = F.when(order == 1, b).otherwise(a)
        tail = F.slice(second, start, F.greatest(F.size(second) - start + 1, F.lit(0)))
        out.append(F.slice(F.concat(first, tail), 1, max_len).alias(f"{name}_tlm"))
    res = df.select(*out, "input_ids_1", "input_ids_2")
    if reset_position_ids:
        res = res.withColumn("position_ids_tlm", tlm_positions(F.col("input_ids_1"), F.col("input_ids_2"),
                                                               F.col("tlm_order"), max_len))
    return res.drop("input_ids_1", "input_ids_2")


def tlm_positions(ids_1: Column, ids_2: Column, order: Column, max_len: int) -> Column:
    """Position ids when each half restarts at ``pad_id + 1``."""
    def pos(a):
        return F.transform(a, lambda _, i: i + F.lit(PAD_ID + 1))
    p1, p2 = pos(ids_1), pos(ids_2)
    return F.slice(F.when(order == 1, F.concat(p1, p2)).otherwise(F.concat(p2, p1)), 1, max_len)


PLACES = [b":%d:" % i for i in range(1 << 10)]


def _masked(vocab_size: int, p: float):
    """Every draw once: a position that is not special takes one, a chosen one up
    to three more."""
    def drawn(keys: list[bytes], row: np.ndarray, at: np.ndarray, tag: bytes) -> np.ndarray:
        return uniforms([keys[r] + (PLACES[i] if i < len(PLACES) else b":%d:" % i) + tag for r, i in zip(row.tolist(), at.tolist())])

    def run(ids: pa.Array, special: pa.Array, key: pa.Array) -> pa.Array:
        offsets, values = flat(ids)
        old = values.to_numpy(zero_copy_only=False)
        marks = flat(special)[1].to_numpy(zero_copy_only=False) if len(old) else old
        keys = [(k or "").encode() for k in key.to_pylist()]
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        at = np.arange(len(old)) - offsets[:-1][row]
        inputs, labels = old.copy(), np.full(len(old), -100, np.int32)
        chosen = np.flatnonzero(marks == 0)
        chosen = chosen[drawn(keys, row[chosen], at[chosen], b"p") < p]
        labels[chosen] = old[chosen]
        kept = drawn(keys, row[chosen], at[chosen], b"r") >= 0.8
        inputs[chosen[~kept]] = MASK_ID
        other = chosen[kept]
        other = other[drawn(keys, row[other], at[other], b"h") < 0.5]
        inputs[other] = (drawn(keys, row[other], at[other], b"id") * vocab_size).astype(np.int32)
        return pa.StructArray.from_arrays([lists(offsets, pa.array(x.astype(np.int32)), ids) for x in (inputs, labels)], ["inputs", "labels"])
    return run


def mlm_mask(ids: Column, special: Column, key: list[Column], seed: int, vocab_size: int,
             p: float = 0.15) -> tuple[Column, Column]:
    """``(masked inputs, labels)``: each non-special position is chosen with
    probability ``p``; a chosen one keeps its id as label (others -100) and
    becomes the mask id (80 %), a random id (half of the rest) or stays. The draws
    are those of :func:`tessera.functions.draws.uniform`."""
    both = F.arrow_udf(_masked(vocab_size, p), "struct<inputs:array<int>,labels:array<int>>")(ids, special, draw_key(seed, *key))
    return both["inputs"], both["labels"]
