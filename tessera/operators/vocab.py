"""Sub-word vocabulary built by Spark, and token → id encoding.

The trained sub-word model of the original is not available offline, so
the default tokenizer is a deterministic piece rule: a word (Python
``str.split`` unit) is cut into chunks of ``piece_len`` characters, the
first chunk marked with ``▁`` like sentence-piece word starts; longest match
against the vocabulary is in :mod:`tessera.operators.subword`. A trained
model plugs in through :func:`tokenize_with` (an Arrow-batched pandas
function, loaded once per Python worker).

The vocabulary is the special pieces followed by the ``vocab_size`` most
frequent pieces of a corpus (ties by piece): a partial aggregate over the
pieces, then a bounded top-k. It is a table and is joined per distinct word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import split_ws, sql_split_ws

# Special pieces and their ids.
BOS, PAD, EOS, UNK, MASK = "<s>", "<pad>", "</s>", "<unk>", "<mask>"
SPECIALS = [BOS, PAD, EOS, UNK, MASK]
BOS_ID, PAD_ID, EOS_ID, UNK_ID, MASK_ID = range(5)
WORD_START = "▁"
HELD = 1 << 18           # distinct words that a task counts before it gives them out
PART = 8 << 20           # bytes of rows that it counts at a time


def word_pieces(word: Column, piece_len: int) -> Column:
    """Pieces of one word: ``▁`` + first chunk, then the following chunks. The
    unknown token is one piece, itself."""
    n = F.greatest(F.ceil(F.length(word) / piece_len), F.lit(1)).cast("int")
    idx = F.sequence(F.lit(0), n - 1)
    cut = F.transform(idx, lambda i: F.concat(F.when(i == 0, F.lit(WORD_START)).otherwise(F.lit("")),
                                              F.substring(word, i * piece_len + 1, piece_len)))
    return F.when(word == UNK, F.array(F.lit(UNK))).otherwise(cut)


def piece_cutter(piece_len: int) -> Callable:
    """The pieces of :func:`word_pieces` in a Python worker: an Arrow array of
    words gives one of lists. All words are cut at once, piece by piece; long words
    give the rest one by one."""
    def cut(words):
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.maximum(-(-size // piece_len), 1)
        n[pc.equal(words, UNK).to_numpy(zero_copy_only=False)] = 1
        ends = np.concatenate([[0], np.cumsum(n)])
        row, left, k, found, places = np.arange(len(words)), words, 0, [], []
        while len(row) and k < 32:
            piece = pc.utf8_slice_codeunits(left, k * piece_len, (k + 1) * piece_len)
            found.append(piece if k else pc.if_else(pc.equal(left, UNK), UNK, pc.binary_join_element_wise(WORD_START, piece, "")))
            places.append(ends[row] + k)
            k += 1
            more = n[row] > k
            row, left = row[more], left.filter(pa.array(more))
        for r, w in zip(row, left.to_pylist()):
            found.append(pa.array([w[i:i + piece_len] for i in range(k * piece_len, len(w), piece_len)], pa.string()))
            places.append(np.arange(ends[r] + k, ends[r + 1]))
        values = pa.concat_arrays(found) if found else pa.array([], pa.string())
        order = np.empty(ends[-1], np.int64)
        order[np.concatenate(places) if places else []] = np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values.take(pa.array(order)))
    return cut


def cut_words(words: DataFrame, piece_len: int, out: str = "pieces") -> DataFrame:
    """Adds the pieces of :func:`word_pieces` to distinct words."""
    return words.withColumn(out, F.arrow_udf(piece_cutter(piece_len), "array<string>")("word"))


def text_pieces(text, piece_len: int) -> Column:
    """All pieces of a text (words split on whitespace)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.flatten(F.transform(split_ws(t), lambda w: word_pieces(w, piece_len)))


def piece_count(word: Column, piece_len: int) -> Column:
    """Number of pieces of a word without materialising them (0 for '')."""
    return F.when(F.length(word) == 0, F.lit(0)).when(word == UNK, F.lit(1)).otherwise(F.ceil(F.length(word) / piece_len)).cast("int")


def word_counts(texts: DataFrame, cols: list[str], cut: Callable | None = None) -> DataFrame:
    """``(word, n)`` over whitespace-split words of the text columns, or over the
    pieces that ``cut`` makes of them.

    Words are counted in Python (``str.split`` is exactly the whitespace rule, at C
    speed). A task gives one row per distinct word of all its rows, or of as many as
    have ``HELD`` distinct words — a map-side combine — which the final ``sum``
    merges; words are cut then. A column of word arrays is taken as it is."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def fn(batches):
        from collections import Counter

        from tessera.operators.tag_arrays import slices

        def rows(held):
            words, n = pa.array(list(held.keys()), pa.string()), np.array(list(held.values()), np.int64)
            if cut is not None:
                pieces = cut(words)
                units = pieces.values.dictionary_encode()
                words, times = units.dictionary, np.repeat(n, pc.list_value_length(pieces).to_numpy())
                n = np.zeros(len(words), np.int64)
                np.add.at(n, units.indices.to_numpy(), times)
            return pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])
        held: Counter = Counter()
        for part in (p for b in batches for p in slices(b, PART)):
            for col in part.columns:
                if pa.types.is_list(col.type):
                    found = col.flatten().value_counts()
                    for word, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                        if word:
                            held[word] += n
                    continue
                for text in col.to_pylist():
                    if text:
                        held.update(text.split())
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)
    return texts.select(*cols).mapInArrow(fn, schema).groupBy("word").agg(F.sum("n").alias("n"))


def build_vocab(texts: DataFrame, text_col: str | list[str], vocab_size: int, piece_len: int,
                pre_split: bool = False) -> DataFrame:
    """``(piece, piece_id, is_special)``; specials first, then the most
    frequent pieces (ties by piece).

    Distinct-word execution: words are counted first, and pieces are cut once
    per distinct word, weighted by the word count (map-side combined, so the
    shuffle carries distinct pieces). ``pre_split``: the (single) column already
    holds one word per row."""
    spark = texts.sparkSession
    cols = [text_col] if isinstance(text_col, str) else list(text_col)
    if pre_split:
        wc = texts.select(F.col(cols[0]).alias("word")).filter(F.length("word") > 0) \
                  .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = cut_words(wc, piece_len).select(F.explode("pieces").alias("piece"), "n") \
            .groupBy("piece").agg(F.sum("n").alias("count"))
    else:
        counts = word_counts(texts, cols, piece_cutter(piece_len)).select(F.col("word").alias("piece"), F.col("n").alias("count"))
    counts = counts.filter(F.col("piece") != UNK)
    top = counts.orderBy(F.desc("count"), F.asc("piece")).limit(vocab_size)
    # ≤ vocab_size rows: a one-partition window here is bounded by the parameter
    ranked = top.select("piece", (F.row_number().over(Window.orderBy(F.desc("count"), F.asc("piece")))
                                  + F.lit(len(SPECIALS) - 1)).cast("int").alias("piece_id"),
                        F.lit(False).alias("is_special"))
    specials = spark.createDataFrame([(p, i, True) for i, p in enumerate(SPECIALS)],
                                     "piece string, piece_id int, is_special boolean")
    return specials.unionByName(ranked)


def encode_texts(df: DataFrame, vocab: DataFrame, cols: dict[str, str], piece_len: int) -> DataFrame:
    """Text columns → id arrays (``cols``: output column → text column):
    whitespace split, pieces cut once per distinct word and given ids once per
    distinct piece of a chunk (:mod:`tessera.operators.subword`)."""
    from tessera.operators.subword import encode_by_words, piece_ids
    return encode_by_words(df, lambda pieces: piece_ids(pieces, vocab), cols, cut=piece_cutter(piece_len))


def encode_word_arrays(df: DataFrame, vocab: DataFrame, cols: dict[str, str], piece_len: int) -> DataFrame:
    """Word-array columns → flattened piece-id arrays (``cols``: output →
    input), like :func:`encode_texts`; the input column is kept."""
    from tessera.operators.subword import encode_by_words, piece_ids
    return encode_by_words(df, lambda pieces: piece_ids(pieces, vocab), cols, keep_input=True, cut=piece_cutter(piece_len))


def encode_ids(pieces: DataFrame, vocab: DataFrame, piece_col: str = "piece") -> DataFrame:
    """Join a piece column with the vocabulary; unknown pieces get the unk id."""
    v = vocab.select(F.col("piece").alias(piece_col), F.col("piece_id"))
    return pieces.join(v, on=piece_col, how="left").withColumn("piece_id", F.coalesce(F.col("piece_id"), F.lit(UNK_ID)))


def tokenize_with(fn: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Hook for a trained tokenizer: ``fn`` maps a batch of texts to a batch
    of piece lists; it runs inside Arrow batches on the executors."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tok(texts: pd.Series) -> pd.Series:
        return fn(texts)
    return tok


# DuckDB twins ---------------------------------------------------------------

def sql_text_pieces(expr: str, piece_len: int) -> str:
    return f"flatten(list_transform({sql_split_ws(expr)}, lambda w: {sql_word_pieces('w', piece_len)}))"


def sql_piece_count(w: str, piece_len: int) -> str:
    return f"CAST(CASE WHEN {w} = '{UNK}' THEN 1 ELSE greatest(ceil(length({w}) / {piece_len}), 1) END AS BIGINT)"


def sql_word_pieces(w: str, piece_len: int) -> str:
    return (f"list_transform(range({sql_piece_count(w, piece_len)}), lambda i: CASE WHEN {w} = '{UNK}' THEN {w} ELSE "
            f"(CASE WHEN i = 0 THEN '{WORD_START}' ELSE '' END) || "
            f"substring({w}, CAST(i * {piece_len} + 1 AS BIGINT), {piece_len}) END)")


def sql_vocab(src_cte: str, text_col: str, vocab_size: int, piece_len: int, name: str = "vocab") -> str:
    specials = " UNION ALL ".join(f"SELECT '{p}' AS piece, {i} AS piece_id, true AS is_special"
                                  for i, p in enumerate(SPECIALS))
    return f"""
{name}_pc AS (SELECT unnest({sql_text_pieces(text_col, piece_len)}) AS piece FROM {src_cte}),
{name}_cnt AS (SELECT piece, count(*) AS cnt FROM {name}_pc WHERE piece <> '{UNK}' GROUP BY piece),
{name}_top AS (SELECT piece, CAST(row_number() OVER (ORDER BY cnt DESC, piece) + {len(SPECIALS) - 1} AS INTEGER) AS piece_id,
                      false AS is_special
               FROM {name}_cnt ORDER BY cnt DESC, piece LIMIT {vocab_size}),
{name} AS ({specials} UNION ALL SELECT piece, piece_id, is_special FROM {name}_top)"""
