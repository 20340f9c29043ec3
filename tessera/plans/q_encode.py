"""Training-data preparation queries: vocabulary, encoding, batching,
padding, TLM concatenation and MLM masking over the valid pair table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.draws import sql_key, sql_uniform
from tessera.operators.batching import (assign_batches, len_stats, pad_batch, prepare_batch,
                                        seeded_shuffle)
from tessera.operators.encode import mlm_mask, pair_encode, tlm_concat
from tessera.operators.pairs import valid_pairs
from tessera.operators.vocab import (EOS_ID, MASK_ID, PAD_ID, UNK_ID, BOS_ID, build_vocab, encode_ids,
                                     encode_texts, sql_text_pieces, sql_vocab, text_pieces)
from tessera.functions.arrays import pad_fixed
from tessera.functions.text import sql_split_ws
from tessera.operators.subword import sql_longest_match, tokenize
from tessera.plans.q_corpus import SQL_VALID, pairs
from tessera.plans.registry import register, table
from tessera.session import checkpoint_dir, stage_table
from tessera.sources.stores import cached_tokens

VOCAB_SIZE, PIECE_LEN, MAX_LEN = 2000, 4, 512
BATCH, PAD_MULTIPLE, FIXED_LEN = 16, 8, 100
RETR_MAX_LEN = 512
TLM_SEED, MLM_SEED, MLM_P = 11, 13, 0.15
LINE_BATCH, SHUFFLE_SEED, SHUFFLE_EPOCH = 128, 5, 2
KEYS = ["doc_id", "line_no"]


def valid(spark, sf, cut: bool = False):
    """Valid pair table; ``cut`` materialises it once (a staged table) when
    several passes read it (vocabulary + encoding)."""
    v = valid_pairs(pairs(spark, sf)).select(*KEYS, "text", "transliteration")
    return stage_table(v, "valid-pairs") if cut else v


def vocab(spark, sf, v=None):
    v = v if v is not None else valid(spark, sf)
    return build_vocab(v, ["text", "transliteration"], VOCAB_SIZE, PIECE_LEN)


def encoded(spark, sf, v=None, keys=KEYS):
    """Encoded pairs, of the staged pair table ``v`` if that is there."""
    v = v if v is not None else valid(spark, sf, cut=True)
    ids = encode_texts(v, vocab(spark, sf, v), {"ids_1": "text", "ids_2": "transliteration"}, PIECE_LEN)
    return pair_encode(ids, keys, F.col("ids_1"), F.col("ids_2"), MAX_LEN)


# ----- SQL fragments ---------------------------------------------------------
SQL_VOCAB = SQL_VALID + """,
vt AS (SELECT text AS t FROM vp UNION ALL SELECT transliteration AS t FROM vp),""" + \
    sql_vocab("vt", "t", VOCAB_SIZE, PIECE_LEN)

_sides = " UNION ALL ".join(
    f"SELECT doc_id, line_no, {s} AS side, {sql_text_pieces(c, PIECE_LEN)} AS pc FROM vp"
    for s, c in ((1, "text"), (2, "transliteration")))
SQL_IDS = SQL_VOCAB + f""",
sp AS ({_sides}),
spx AS (SELECT doc_id, line_no, side, unnest(range(len(pc))) AS pos, unnest(pc) AS piece FROM sp),
spi AS (SELECT spx.doc_id, spx.line_no, spx.side,
               list(coalesce(vocab.piece_id, {UNK_ID}) ORDER BY spx.pos) AS ids
        FROM spx LEFT JOIN vocab ON spx.piece = vocab.piece GROUP BY ALL),
ids2 AS (SELECT vp.doc_id, vp.line_no,
                coalesce(a.ids, []::INTEGER[]) AS ids_1, coalesce(b.ids, []::INTEGER[]) AS ids_2
         FROM vp LEFT JOIN spi a ON a.doc_id = vp.doc_id AND a.line_no = vp.line_no AND a.side = 1
                 LEFT JOIN spi b ON b.doc_id = vp.doc_id AND b.line_no = vp.line_no AND b.side = 2)"""


def _sql_side(ids, s):
    full = f"list_concat([{BOS_ID}], {ids}[1:{MAX_LEN - 2}], [{EOS_ID}])"
    return (f"{full} AS input_ids_{s}, list_transform({full}, lambda x: 1) AS attention_mask_{s}, "
            f"list_transform(range(len({full})), lambda i: CASE WHEN i = 0 OR i = len({full}) - 1 "
            f"THEN 1 ELSE 0 END) AS special_tokens_mask_{s}, "
            f"list_transform({full}, lambda x: 0) AS token_type_ids_{s}")


SQL_ENC = SQL_IDS + f""",
enc AS (SELECT doc_id, line_no, {_sql_side('ids_1', 1)}, {_sql_side('ids_2', 2)} FROM ids2)"""


register("vocab_build", f"WITH {SQL_VOCAB} SELECT piece, piece_id, is_special FROM vocab")(vocab)


def q_token_ids(spark, sf):
    v = valid(spark, sf, cut=True)
    pieces = (v.select(F.explode(text_pieces("text", PIECE_LEN)).alias("piece"))
              .unionByName(v.select(F.explode(text_pieces("transliteration", PIECE_LEN)).alias("piece")))
              .distinct())
    return encode_ids(pieces, vocab(spark, sf, v)).select("piece", "piece_id")


register("token_ids", f"""WITH {SQL_IDS}
SELECT DISTINCT spx.piece, coalesce(vocab.piece_id, {UNK_ID}) AS piece_id
FROM spx LEFT JOIN vocab ON spx.piece = vocab.piece""")(q_token_ids)


def q_tokenize(spark, sf):
    v = valid(spark, sf, cut=True)
    return tokenize(v, vocab(spark, sf, v), {"tokens_1": "text", "tokens_2": "transliteration"})


_tok = " UNION ALL ".join(
    f"SELECT doc_id, line_no, {s} AS side, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT *, {sql_split_ws(c)} AS ws FROM vp)"
    for s, c in ((1, "text"), (2, "transliteration")))
register("tokenize", f"""WITH RECURSIVE {SQL_VOCAB.lstrip()},
tw AS MATERIALIZED ({_tok}),
{sql_longest_match("tw")},
ti AS (SELECT doc_id, line_no, side, flatten(list(wid.ids ORDER BY pos)) AS ids FROM tw JOIN wid ON wid.word = tw.word GROUP BY ALL)
SELECT vp.doc_id, vp.line_no, coalesce(a.ids, []::INTEGER[]) AS tokens_1, coalesce(b.ids, []::INTEGER[]) AS tokens_2
FROM vp LEFT JOIN ti a ON a.doc_id = vp.doc_id AND a.line_no = vp.line_no AND a.side = 1
        LEFT JOIN ti b ON b.doc_id = vp.doc_id AND b.line_no = vp.line_no AND b.side = 2""")(q_tokenize)

register("pair_encode", f"WITH {SQL_ENC} SELECT * FROM enc")(encoded)


def q_tok_cache(spark, sf):
    """Tokens per line, written once; the second request reads what the
    first one wrote."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"tokens-{uuid.uuid4().hex[:12]}")

    def build():
        v = valid_pairs(pairs(spark, sf))
        return v.select("lang", *KEYS, text_pieces("text", PIECE_LEN).alias("tokens"))

    cached_tokens(spark, path, build)
    return cached_tokens(spark, path, build).select("lang", *KEYS, F.concat_ws(" ", "tokens").alias("tokens"))


register("tok_cache", f"""WITH {SQL_VALID}
SELECT lang, doc_id, line_no, array_to_string({sql_text_pieces('text', PIECE_LEN)}, ' ') AS tokens FROM vp""")(q_tok_cache)


def q_len_stats(spark, sf):
    e = stage_table(encoded(spark, sf).select(*KEYS, F.size("input_ids_1").alias("n_tokens")), "encoded-sizes")
    b = assign_batches(e, [F.col(k) for k in KEYS], BATCH)
    return len_stats(b, "batch_id", "n_tokens", RETR_MAX_LEN)


register("len_stats", f"""WITH {SQL_ENC},
b AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // {BATCH} AS batch_id FROM enc)
SELECT CAST(batch_id AS BIGINT) AS batch_id, max(len(input_ids_1)) AS max_tokens,
       least(max(len(input_ids_1)) + 2, {RETR_MAX_LEN}) AS local_length, count(*) AS n_rows
FROM b GROUP BY batch_id""")(q_len_stats)


def q_batch_assign(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    b = assign_batches(li, [F.col("l_orderkey"), F.col("l_linenumber")], LINE_BATCH)
    return b.select("l_orderkey", "l_linenumber", "row_no", "batch_id", "pos_in_batch")


register("batch_assign", f"""
SELECT l_orderkey, l_linenumber, CAST(rn AS BIGINT) AS row_no, CAST(rn // {LINE_BATCH} AS BIGINT) AS batch_id,
       CAST(rn % {LINE_BATCH} AS INTEGER) AS pos_in_batch
FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rn
      FROM lineitem)""")(q_batch_assign)


def q_seeded_shuffle(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return seeded_shuffle(li, SHUFFLE_SEED, SHUFFLE_EPOCH, ["l_orderkey", "l_linenumber"]) \
        .select("l_orderkey", "l_linenumber", "shuffle_pos")


_SK = f"md5({sql_key(str(SHUFFLE_SEED), str(SHUFFLE_EPOCH), 'l_orderkey', 'l_linenumber')})"
register("seeded_shuffle", f"""
SELECT l_orderkey, l_linenumber,
       CAST(row_number() OVER (ORDER BY {_SK}, l_orderkey, l_linenumber) - 1 AS BIGINT) AS shuffle_pos
FROM lineitem""")(q_seeded_shuffle)


def q_pad_batch(spark, sf):
    # rows are numbered by their keys alone and meet their batch again by a row id
    v = stage_table(valid(spark, sf).withColumn("row_id", F.monotonically_increasing_id()), "valid-pairs")
    e = encoded(spark, sf, v, [*KEYS, "row_id"]).select("row_id", *KEYS, "input_ids_1", "attention_mask_1", "special_tokens_mask_1")
    b = e.join(assign_batches(v.select(*KEYS, "row_id"), [F.col(k) for k in KEYS], BATCH).select("row_id", "batch_id"), "row_id")
    p = pad_batch(b, "batch_id", {"input_ids_1": PAD_ID, "attention_mask_1": 0, "special_tokens_mask_1": 1},
                  "input_ids_1", PAD_MULTIPLE)
    return p.select(*KEYS, "batch_id", "padded_len", "input_ids_1", "attention_mask_1", "special_tokens_mask_1")


def _sql_pad(col, n, v):
    return f"list_concat({col}, list_transform(range(greatest({n} - len({col}), 0)), lambda z: {v}))"


register("pad_batch", f"""WITH {SQL_ENC},
b AS (SELECT *, CAST((row_number() OVER (ORDER BY doc_id, line_no) - 1) // {BATCH} AS BIGINT) AS batch_id FROM enc),
m AS (SELECT *, CAST(ceil(max(len(input_ids_1)) OVER (PARTITION BY batch_id) / {PAD_MULTIPLE}) * {PAD_MULTIPLE}
                     AS INTEGER) AS padded_len FROM b)
SELECT doc_id, line_no, batch_id, padded_len,
       {_sql_pad('input_ids_1', 'padded_len', PAD_ID)} AS input_ids_1,
       {_sql_pad('attention_mask_1', 'padded_len', 0)} AS attention_mask_1,
       {_sql_pad('special_tokens_mask_1', 'padded_len', 1)} AS special_tokens_mask_1
FROM m""")(q_pad_batch)


def q_prepare_batch(spark, sf):
    v = valid(spark, sf, cut=True)
    t = encode_texts(v.select(*KEYS, "text"), vocab(spark, sf, v), {"tokens": "text"}, PIECE_LEN)
    t = stage_table(t, "encoded-tokens")
    b = assign_batches(t, [F.col(k) for k in KEYS], BATCH).drop("row_no", "pos_in_batch")
    return prepare_batch(b, "batch_id", "tokens", RETR_MAX_LEN)


register("prepare_batch", f"""WITH {SQL_IDS},
b AS (SELECT doc_id, line_no, ids_1 AS tokens,
             CAST((row_number() OVER (ORDER BY doc_id, line_no) - 1) // {BATCH} AS BIGINT) AS batch_id FROM ids2),
l AS (SELECT *, CAST(least(max(len(tokens)) OVER (PARTITION BY batch_id) + 2, {RETR_MAX_LEN}) AS INTEGER) AS L FROM b),
i AS (SELECT *, list_concat([{BOS_ID}], tokens[1:greatest(L - 2, 0)], [{EOS_ID}]) AS ids FROM l)
SELECT doc_id, line_no, batch_id, L AS max_length,
       {_sql_pad('ids', 'L', PAD_ID)} AS input_ids,
       list_concat(list_transform(ids, lambda z: 1), list_transform(range(greatest(L - len(ids), 0)), lambda z: 0))
         AS attention_mask,
       list_concat([0], list_transform(range(len(ids) - 2), lambda z: 1),
                   list_transform(range(greatest(L - len(ids), 0) + 1), lambda z: 0)) AS pool_mask
FROM i""")(q_prepare_batch)


def q_pad_fixed(spark, sf):
    e = encoded(spark, sf)
    return e.select(*KEYS, pad_fixed("input_ids_1", FIXED_LEN, PAD_ID).alias("input_ids"),
                    pad_fixed("attention_mask_1", FIXED_LEN, 0).alias("attention_mask"),
                    pad_fixed("input_ids_2", FIXED_LEN, PAD_ID, left=True).alias("input_ids_left"))


register("pad_fixed", f"""WITH {SQL_ENC}
SELECT doc_id, line_no, {_sql_pad('input_ids_1', FIXED_LEN, PAD_ID)} AS input_ids,
       {_sql_pad('attention_mask_1', FIXED_LEN, 0)} AS attention_mask,
       list_concat(list_transform(range(greatest({FIXED_LEN} - len(input_ids_2), 0)), lambda z: {PAD_ID}),
                   input_ids_2) AS input_ids_left
FROM enc""")(q_pad_fixed)

_COIN = f"(CASE WHEN {sql_uniform(sql_key(str(TLM_SEED), 'doc_id', 'line_no', repr('tlm')))} < 0.5 THEN 1 ELSE 0 END)"


def _sql_tlm(start):
    parts = []
    for n in ("input_ids", "attention_mask", "special_tokens_mask", "token_type_ids"):
        a, b = f"{n}_1", f"{n}_2"
        parts.append(f"(CASE WHEN o = 1 THEN list_concat({a}, {b}[{start}:]) "
                     f"ELSE list_concat({b}, {a}[{start}:]) END)[1:{MAX_LEN}] AS {n}_tlm")
    return ", ".join(parts)


def q_tlm_concat(spark, sf):
    return tlm_concat(encoded(spark, sf), KEYS, MAX_LEN, TLM_SEED, reset_position_ids=False)


register("tlm_concat", f"""WITH {SQL_ENC},
o AS (SELECT *, {_COIN} AS o FROM enc)
SELECT doc_id, line_no, o AS tlm_order, {_sql_tlm(2)} FROM o""")(q_tlm_concat)


def q_tlm_positions(spark, sf):
    t = tlm_concat(encoded(spark, sf), KEYS, MAX_LEN, TLM_SEED, reset_position_ids=True)
    return t.select(*KEYS, "tlm_order", "input_ids_tlm", "position_ids_tlm")


_P = lambda c: f"list_transform(range(len({c})), lambda i: CAST(i + {PAD_ID + 1} AS INTEGER))"
register("tlm_positions", f"""WITH {SQL_ENC},
o AS (SELECT *, {_COIN} AS o FROM enc)
SELECT doc_id, line_no, o AS tlm_order,
       (CASE WHEN o = 1 THEN list_concat(input_ids_1, input_ids_2) ELSE list_concat(input_ids_2, input_ids_1) END)[1:{MAX_LEN}]
         AS input_ids_tlm,
       (CASE WHEN o = 1 THEN list_concat({_P('input_ids_1')}, {_P('input_ids_2')})
             ELSE list_concat({_P('input_ids_2')}, {_P('input_ids_1')}) END)[1:{MAX_LEN}] AS position_ids_tlm
FROM o""")(q_tlm_positions)


def q_mlm_mask(spark, sf):
    v = valid(spark, sf, cut=True)
    voc = vocab(spark, sf, v).cache()
    vsize = voc.count()
    ids = encode_texts(v, voc, {"ids_1": "text", "ids_2": "transliteration"}, PIECE_LEN)
    e = pair_encode(ids, KEYS, F.col("ids_1"), F.col("ids_2"), MAX_LEN)
    inputs, labels = mlm_mask(F.col("input_ids_1"), F.col("special_tokens_mask_1"),
                              [F.col("doc_id"), F.col("line_no"), F.lit(1)], MLM_SEED, vsize, MLM_P)
    return e.select(*KEYS, inputs.alias("input_ids"), labels.alias("labels"))


def _d(tag):
    return sql_uniform(sql_key(str(MLM_SEED), "doc_id", "line_no", "1", "i", repr(tag)))


_CH = f"(special_tokens_mask_1[i + 1] = 0 AND {_d('p')} < {MLM_P})"
register("mlm_mask", f"""WITH {SQL_ENC},
vs AS (SELECT count(*) AS vsize FROM vocab)
SELECT doc_id, line_no,
       list_transform(range(len(input_ids_1)), lambda i: CAST(CASE WHEN {_CH} THEN
           (CASE WHEN {_d('r')} < 0.8 THEN {MASK_ID}
                 WHEN {_d('h')} < 0.5 THEN floor({_d('id')} * vsize)
                 ELSE input_ids_1[i + 1] END)
           ELSE input_ids_1[i + 1] END AS INTEGER)) AS input_ids,
       list_transform(range(len(input_ids_1)), lambda i: CAST(CASE WHEN {_CH} THEN input_ids_1[i + 1] ELSE -100 END
           AS INTEGER)) AS labels
FROM enc, vs""")(q_mlm_mask)
