"""Retrieval, pooling and vector queries over the ``embeddings`` table.

Derivation (same in Spark and in the SQL oracle): the stored vectors are
the *source* side ``x``; the *target* side is made deterministically as
``y_i = normalise(2·u_i·x_i + x_(i+1) + x_(i+2) + x_(i+3))`` (indices mod
n, ``u_i`` the md5 draw of ``i``), so target ``i``'s gold neighbour is
source ``i`` with realistic near misses.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import l2_normalize, sql_l2_distance, sql_l2_normalize
from tessera.functions.draws import sql_key, sql_uniform, uniform
from tessera.operators.pivots import topk_pruned
from tessera.operators.pooling import cls_pool, mean_pool
from tessera.operators.retrieval import (gold_distance, layer_select, retrieval_acc,
                                         topk_neighbours)
from tessera.plans.registry import register, table
from tessera.session import checkpoint_dir
from tessera.sources.stores import layers_complete, read_layer, write_layers, write_predictions

K = 10
TOTAL_LAYERS, NUM_LAYERS, LAYER_INDEX = 13, 12, 7
TOKENS_PER_SENT, TOKEN_DIM = 8, 8


def sources(spark, sf_dir) -> DataFrame:
    return (table(spark, sf_dir, "embeddings")
            .select(F.col("vec_id").alias("idx"), l2_normalize("embedding").alias("vec")))


def targets(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))
    n = x.count()  # scalar: the modulus of the index arithmetic
    offs = F.explode(F.array(*[F.lit(o) for o in range(4)]))
    c = x.select("vec", offs.alias("off"), F.col("idx").alias("src"))
    c = c.withColumn("idx", F.pmod(F.col("src") - F.col("off"), F.lit(n)))
    g = c.groupBy("idx").agg(*[F.first(F.when(F.col("off") == o, F.col("vec")), ignorenulls=True).alias(f"v{o}")
                               for o in range(4)])
    w = F.lit(2.0) * uniform(F.col("idx"))
    s = F.zip_with("v0", "v1", lambda a, b: w * a + b)
    s = F.zip_with(s, "v2", lambda a, b: a + b)
    s = F.zip_with(s, "v3", lambda a, b: a + b)
    return g.select("idx", l2_normalize(s).alias("vec"))


SQL_SIDES = f"""
x AS (SELECT vec_id AS idx, {sql_l2_normalize('embedding')} AS vec FROM embeddings),
xr AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
nn AS (SELECT count(*) AS n FROM xr),
c AS (SELECT ((xr.idx - o.off) % nn.n + nn.n) % nn.n AS idx, o.off, xr.vec
      FROM xr, nn, (VALUES (0), (1), (2), (3)) AS o(off)),
g AS (SELECT idx,
             2.0 * {sql_uniform(sql_key('idx'))} AS w,
             max(CASE WHEN off = 0 THEN vec END) AS v0, max(CASE WHEN off = 1 THEN vec END) AS v1,
             max(CASE WHEN off = 2 THEN vec END) AS v2, max(CASE WHEN off = 3 THEN vec END) AS v3
      FROM c GROUP BY idx),
s AS (SELECT idx, list_transform(list_zip(v0, v1, v2, v3, list_transform(v0, lambda z: w)),
                                 lambda p: p[5] * p[1] + p[2] + p[3] + p[4]) AS vec FROM g),
y AS (SELECT idx, {sql_l2_normalize('vec')} AS vec FROM s)"""

SQL_TOPK = f"""
WITH {SQL_SIDES},
d AS (SELECT y.idx AS query_idx, x.idx AS neighbour_idx, {sql_l2_distance('y.vec', 'x.vec')} AS dist
      FROM y, x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY round(dist, 9), neighbour_idx) AS rank
      FROM d)
SELECT query_idx, CAST(rank AS INTEGER) AS rank, neighbour_idx, round(dist, 6) AS distance
FROM r WHERE rank <= {K}"""


def _cut(df):
    """Stage cut for a side read by the block-count action and the plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def q_retrieval_topk(spark, sf_dir):
    return topk_neighbours(_cut(targets(spark, sf_dir)), _cut(sources(spark, sf_dir)), K)


register("retrieval_topk", SQL_TOPK)(q_retrieval_topk)


def q_retrieval_pruned(spark, sf_dir):
    """The same neighbours by pivots and the triangle inequality."""
    return topk_pruned(_cut(targets(spark, sf_dir)), _cut(sources(spark, sf_dir)), K, block_rows=256)


register("retrieval_pruned", SQL_TOPK)(q_retrieval_pruned)


def q_retrieval_acc(spark, sf_dir):
    y = _cut(targets(spark, sf_dir))
    nn = topk_neighbours(y, _cut(sources(spark, sf_dir)), K)
    return retrieval_acc(nn, y)


register("retrieval_acc", f"""
WITH {SQL_SIDES},
d AS (SELECT y.idx AS query_idx, x.idx AS neighbour_idx, {sql_l2_distance('y.vec', 'x.vec')} AS dist
      FROM y, x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY round(dist, 9), neighbour_idx) AS rank
      FROM d),
h AS (SELECT query_idx, min(rank) AS gold_rank FROM r WHERE rank <= {K} AND query_idx = neighbour_idx
      GROUP BY query_idx)
SELECT round(avg(CASE WHEN gold_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS acc1,
       round(avg(CASE WHEN gold_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS acc5,
       round(avg(CASE WHEN gold_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS acc10,
       count(*) AS n_queries
FROM y LEFT JOIN h ON y.idx = h.query_idx""")(q_retrieval_acc)


def q_pair_distance(spark, sf_dir):
    return gold_distance(targets(spark, sf_dir), sources(spark, sf_dir))


register("pair_distance", f"""
WITH {SQL_SIDES}
SELECT y.idx AS idx, round({sql_l2_distance('y.vec', 'x.vec')}, 6) AS distance
FROM y JOIN x ON y.idx = x.idx""")(q_pair_distance)


def q_l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = l2_normalize("embedding")
    return e.select("vec_id", F.transform(v, lambda z: F.round(z, 6)).alias("vec"))


register("l2_normalize", f"""
SELECT vec_id, list_transform({sql_l2_normalize('embedding')}, lambda z: round(z, 6)) AS vec
FROM embeddings""")(q_l2_normalize)


# Token vectors: each stored vector is read as TOKENS_PER_SENT token vectors
# of TOKEN_DIM dims; the sentence has 3 + vec_id % 6 real tokens, the first
# and the last real one being begin/end specials, the rest padding.
def token_vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    length = F.lit(3) + F.pmod(F.col("vec_id"), F.lit(6))
    t = e.select(F.col("vec_id").alias("sent_id"), "embedding", length.alias("n_real"),
                 F.explode(F.sequence(F.lit(0), F.lit(TOKENS_PER_SENT - 1))).alias("pos"))
    absolute = TOTAL_LAYERS - NUM_LAYERS + LAYER_INDEX
    return t.select(
        "sent_id", F.lit(absolute).alias("layer"), F.col("pos").cast("int").alias("pos"),
        F.slice("embedding", F.col("pos") * TOKEN_DIM + 1, TOKEN_DIM).cast("array<double>").alias("vec"),
        (F.col("pos") < F.col("n_real")).cast("int").alias("attention_mask"),
        ((F.col("pos") >= 1) & (F.col("pos") <= F.col("n_real") - 2)).cast("int").alias("pool_mask"))


SQL_TOKENS = f"""
t AS (SELECT vec_id AS sent_id, p.pos, 3 + vec_id % 6 AS n_real,
             CAST(embedding[p.pos * {TOKEN_DIM} + 1 : p.pos * {TOKEN_DIM} + {TOKEN_DIM}] AS DOUBLE[]) AS vec
      FROM embeddings, range({TOKENS_PER_SENT}) AS p(pos)),
tm AS (SELECT sent_id, pos, vec, CASE WHEN pos < n_real THEN 1 ELSE 0 END AS attention_mask,
              CASE WHEN pos >= 1 AND pos <= n_real - 2 THEN 1 ELSE 0 END AS pool_mask FROM t)"""


def q_mean_pool(spark, sf_dir):
    return mean_pool(token_vectors(spark, sf_dir),
                     {"pooled_all": "attention_mask", "pooled_content": "pool_mask"}, round_to=6)


register("mean_pool", f"""
WITH {SQL_TOKENS},
e AS (SELECT sent_id, d.dim, tm.vec[d.dim + 1] AS x, attention_mask, pool_mask
      FROM tm, range({TOKEN_DIM}) AS d(dim)),
s AS (SELECT sent_id, dim, sum(x * attention_mask) / sum(attention_mask) AS a,
             sum(x * pool_mask) / sum(pool_mask) AS b FROM e GROUP BY sent_id, dim)
SELECT sent_id, {TOTAL_LAYERS - NUM_LAYERS + LAYER_INDEX} AS layer,
       list(round(a, 6) ORDER BY dim) AS pooled_all, list(round(b, 6) ORDER BY dim) AS pooled_content
FROM s GROUP BY sent_id""")(q_mean_pool)


def q_cls_pool(spark, sf_dir):
    p = cls_pool(token_vectors(spark, sf_dir))
    return p.select("sent_id", "layer", F.transform("pooled", lambda z: F.round(z, 6)).alias("pooled"))


register("cls_pool", f"""
WITH {SQL_TOKENS}
SELECT sent_id, {TOTAL_LAYERS - NUM_LAYERS + LAYER_INDEX} AS layer,
       list_transform(vec, lambda z: round(z, 6)) AS pooled FROM tm WHERE pos = 0""")(q_cls_pool)


# Layered embeddings: layer l of sentence i is x_i scaled by (l + 1); the
# selection keeps one absolute layer.
def layered(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"),
                    F.explode(F.sequence(F.lit(0), F.lit(TOTAL_LAYERS - 1))).alias("layer"),
                    "embedding").select(
        "idx", F.col("layer").cast("int").alias("layer"),
        F.transform(F.col("embedding").cast("array<double>"),
                    lambda z: z * (F.col("layer") + 1)).alias("vec"))


def q_layer_select(spark, sf_dir):
    sel = layer_select(layered(spark, sf_dir), TOTAL_LAYERS, NUM_LAYERS, LAYER_INDEX)
    return sel.select("idx", "layer", F.round(F.aggregate("vec", F.lit(0.0), lambda a, z: a + z), 6)
                      .alias("vec_sum"))


register("layer_select", f"""
WITH l AS (SELECT vec_id AS idx, CAST(r.layer AS INTEGER) AS layer,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * (r.layer + 1)) AS vec
           FROM embeddings, range({TOTAL_LAYERS}) AS r(layer))
SELECT idx, layer, round(list_reduce(list_prepend(0.0, vec), lambda a, z: a + z), 6) AS vec_sum
FROM l WHERE layer = {TOTAL_LAYERS - NUM_LAYERS + LAYER_INDEX}""")(q_layer_select)


def q_emb_layer_read(spark, sf_dir):
    """All layers written to the store, one of them read back."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"layers-{uuid.uuid4().hex[:12]}")
    if not layers_complete(spark, path, TOTAL_LAYERS):
        write_layers(layered(spark, sf_dir), path)
    sel = read_layer(spark, path, TOTAL_LAYERS, NUM_LAYERS, LAYER_INDEX)
    return sel.select("idx", "layer", F.round(F.aggregate("vec", F.lit(0.0), lambda a, z: a + z), 6).alias("vec_sum"))


register("emb_layer_read", f"""
WITH l AS (SELECT vec_id AS idx, CAST(r.layer AS INTEGER) AS layer,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * (r.layer + 1)) AS vec
           FROM embeddings, range({TOTAL_LAYERS}) AS r(layer))
SELECT idx, layer, round(list_reduce(list_prepend(0.0, vec), lambda a, z: a + z), 6) AS vec_sum
FROM l WHERE layer = {TOTAL_LAYERS - NUM_LAYERS + LAYER_INDEX}""")(q_emb_layer_read)


# Languages of the vectors: one with half of all rows, two with a quarter.
LANG_OF = ["eng_Latn", "ell_Grek", "eng_Latn", "rus_Cyrl"]


def _lang(idx="idx"):
    return F.element_at(F.array(*[F.lit(x) for x in LANG_OF]), (F.pmod(F.col(idx), F.lit(len(LANG_OF))) + 1).cast("int"))


def lang_sides(spark, sf_dir):
    return tuple(_cut(side(spark, sf_dir).withColumn("lang", _lang())) for side in (targets, sources))


SQL_LANG_TOPK = SQL_SIDES + f""",
ln AS (SELECT idx, (ARRAY{LANG_OF})[CAST(idx % {len(LANG_OF)} AS INTEGER) + 1] AS lang FROM x),
xl AS (SELECT x.idx, x.vec, ln.lang FROM x JOIN ln USING (idx)),
yl AS (SELECT y.idx, y.vec, ln.lang FROM y JOIN ln USING (idx)),
d AS (SELECT yl.lang, yl.idx AS query_idx, xl.idx AS neighbour_idx, {sql_l2_distance('yl.vec', 'xl.vec')} AS dist
      FROM yl JOIN xl ON yl.lang = xl.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY round(dist, 9), neighbour_idx) AS rank FROM d)"""


def q_retrieval_acc_lang(spark, sf_dir):
    y, x = lang_sides(spark, sf_dir)
    return retrieval_acc(topk_neighbours(y, x, K, group_cols=["lang"]), y, group_cols=["lang"])


register("retrieval_acc_lang", f"""
WITH {SQL_LANG_TOPK},
h AS (SELECT query_idx, min(rank) AS gold_rank FROM r WHERE rank <= {K} AND query_idx = neighbour_idx
      GROUP BY query_idx)
SELECT yl.lang, round(avg(CASE WHEN gold_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS acc1,
       round(avg(CASE WHEN gold_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS acc5,
       round(avg(CASE WHEN gold_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS acc10, count(*) AS n_queries
FROM yl LEFT JOIN h ON yl.idx = h.query_idx GROUP BY yl.lang""")(q_retrieval_acc_lang)


def q_predictions(spark, sf_dir):
    """Neighbour lists of every language through the prediction store."""
    y, x = lang_sides(spark, sf_dir)
    nn = topk_neighbours(y, x, K, group_cols=["lang"])
    lists = nn.groupBy("lang", "query_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour_idx"))), lambda s: s["neighbour_idx"])
        .alias("neighbours"))
    path = os.path.join(checkpoint_dir(spark), "tables", f"predictions-{uuid.uuid4().hex[:12]}")
    write_predictions(lists, path)
    return spark.read.parquet(path).select("lang", "query_idx", "neighbours")


register("predictions", f"""
WITH {SQL_LANG_TOPK}
SELECT lang, query_idx, list(neighbour_idx ORDER BY rank) AS neighbours FROM r WHERE rank <= {K}
GROUP BY lang, query_idx""")(q_predictions)
