"""Loss queries over supplied vectors / logits / training logs.

* token logits: each stored vector read as 8 positions × 8 logits (scaled
  ×10); a position is masked (has a label) with probability 0.15;
* contrastive pairs: source vector i and its target-side partner i
  (see :mod:`tessera.plans.q_retrieval`), 10 pairs per batch;
* training log: ``events`` as logged loss values — hourly step since
  2024-01-01, rank = user_id % 4, component by event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.arrays import sql_dot, sql_l2_normalize
from tessera.functions.draws import sql_key, sql_uniform, uniform
from tessera.operators.losses import (contrastive_loss, interleave, log_interval_losses, masked_nll,
                                      rank_mean, total_loss)
from tessera.plans.q_retrieval import SQL_SIDES, sources, targets
from tessera.plans.registry import register, table

MLM_SEED, MASK_P, N_POS, VOCAB = 23, 0.15, 8, 8
PAIRS_PER_BATCH, TEMPERATURE, NEG_SEED, NEGATIVES = 10, 0.1, 29, 1.5
EPOCH0 = 1704067200  # 2024-01-01T00:00:00Z
RANKS, LOG_EVERY, TCM_WEIGHT = 4, 24, 0.5
# Event type → loss component of the training log derivation.
COMPONENTS = {"click": "lm_1", "view": "lm_2", "purchase": "tcm", "signup": "tlm", "error": "tcm"}


def token_logits(spark, sf):
    e = table(spark, sf, "embeddings")
    t = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(N_POS - 1))).alias("pos"))
    lab = F.when(uniform(F.lit(MLM_SEED), F.col("vec_id"), F.col("pos")) < MASK_P,
                 F.pmod(F.col("vec_id") + F.col("pos"), F.lit(VOCAB))).otherwise(F.lit(-100)).cast("int")
    logits = F.transform(F.slice("embedding", F.col("pos") * VOCAB + 1, VOCAB).cast("array<double>"),
                         lambda x: x * 10.0)
    return t.select("vec_id", F.col("pos").cast("int").alias("pos"), logits.alias("logits"), lab.alias("label"))


def q_masked_nll(spark, sf):
    r = masked_nll(token_logits(spark, sf))
    return r.select("n_masked", F.round("nll", 6).alias("nll"), F.round("perplexity", 6).alias("perplexity"))


_UM = sql_uniform(sql_key(str(MLM_SEED), "vec_id", "p.pos"))
register("masked_nll", f"""
WITH t AS (SELECT vec_id, p.pos,
                  list_transform(CAST(embedding[p.pos * {VOCAB} + 1 : p.pos * {VOCAB} + {VOCAB}] AS DOUBLE[]),
                                 lambda x: x * 10.0) AS logits,
                  CASE WHEN {_UM} < {MASK_P} THEN (vec_id + p.pos) % {VOCAB} ELSE -100 END AS label
           FROM embeddings, range({N_POS}) AS p(pos)),
n AS (SELECT list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
             - logits[label + 1] AS nll FROM t WHERE label <> -100)
SELECT count(*) AS n_masked, round(avg(nll), 6) AS nll, round(exp(avg(nll)), 6) AS perplexity FROM n""")(q_masked_nll)


def contrastive_vectors(spark, sf):
    x = sources(spark, sf).withColumnRenamed("vec", "v1")
    y = targets(spark, sf).withColumnRenamed("vec", "v2")
    p = x.join(y, on="idx").select(F.floor(F.col("idx") / PAIRS_PER_BATCH).cast("long").alias("batch_id"),
                                   F.pmod("idx", F.lit(PAIRS_PER_BATCH)).cast("long").alias("pos"), "v1", "v2")
    return interleave(p, "batch_id", "pos", "v1", "v2")


def q_contrastive(spark, sf):
    r = contrastive_loss(contrastive_vectors(spark, sf), TEMPERATURE)
    return r.select("batch_id", F.round("loss", 6).alias("loss"), "n_vectors")


_SQL_PV = f"""{SQL_SIDES},
pv AS (SELECT CAST(x.idx // {PAIRS_PER_BATCH} AS BIGINT) AS batch_id, 2 * (x.idx % {PAIRS_PER_BATCH}) AS i, x.vec
       FROM x JOIN y ON x.idx = y.idx
       UNION ALL
       SELECT CAST(y.idx // {PAIRS_PER_BATCH} AS BIGINT), 2 * (y.idx % {PAIRS_PER_BATCH}) + 1, y.vec
       FROM y JOIN x ON x.idx = y.idx)"""
_SQL_LOSS = """r AS (SELECT batch_id, i, max(s) AS m, max(CASE WHEN j = xor(i, 1) THEN s END) AS sp, list(s) AS ss
      FROM sim GROUP BY batch_id, i),
l AS (SELECT batch_id, m + ln(list_sum(list_transform(ss, lambda v: exp(v - m)))) - sp AS nll FROM r)
SELECT batch_id, round(avg(nll) * 0.5, 6) AS loss, count(*) AS n_vectors FROM l GROUP BY batch_id"""

register("contrastive_loss", f"""
WITH {_SQL_PV},
sim AS (SELECT a.batch_id, a.i, b.i AS j, {sql_dot('a.vec', 'b.vec')} / {TEMPERATURE} AS s
      FROM pv a JOIN pv b ON a.batch_id = b.batch_id AND a.i <> b.i),
{_SQL_LOSS}""")(q_contrastive)


def q_contrastive_smooth(spark, sf):
    r = contrastive_loss(contrastive_vectors(spark, sf), TEMPERATURE, cosine=True, negatives=NEGATIVES, seed=NEG_SEED)
    return r.select("batch_id", F.round("loss", 6).alias("loss"), "n_vectors")


def _sql_normal():
    u1, u2 = (sql_uniform(sql_key(str(NEG_SEED), "batch_id", "k", "d", repr(t))) for t in ("n1", "n2"))
    return f"sqrt(-2.0 * ln(1.0 - {u1})) * cos(2 * pi() * {u2})"


register("contrastive_smooth", f"""
WITH {_SQL_PV},
pn AS MATERIALIZED (SELECT batch_id, i, {sql_l2_normalize('vec')} AS vec FROM pv),
nb AS (SELECT batch_id, CAST(floor(count(*) * {NEGATIVES}) AS BIGINT) AS n, any_value(len(vec)) AS dim FROM pn GROUP BY batch_id),
nk AS (SELECT batch_id, dim, unnest(range(n)) AS k FROM nb),
nv AS (SELECT batch_id, k, list_transform(range(dim), lambda d: {_sql_normal()}) AS raw FROM nk),
ng AS MATERIALIZED (SELECT batch_id, k, {sql_l2_normalize('raw')} AS vec FROM nv),
sim AS (SELECT a.batch_id, a.i, b.i AS j, {sql_dot('a.vec', 'b.vec')} / {TEMPERATURE} AS s
        FROM pn a JOIN pn b ON a.batch_id = b.batch_id AND a.i <> b.i
        UNION ALL SELECT a.batch_id, a.i, -1, {sql_dot('a.vec', 'b.vec')} / {TEMPERATURE} FROM pn a JOIN ng b ON a.batch_id = b.batch_id),
{_SQL_LOSS}""")(q_contrastive_smooth)


def loss_log(spark, sf):
    ev = table(spark, sf, "events")
    comp = F.create_map(*[x for k, v in COMPONENTS.items() for x in (F.lit(k), F.lit(v))])
    step = (F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(EPOCH0)) / 3600) + 1).cast("long")
    return ev.select(step.alias("step"), F.pmod("user_id", F.lit(RANKS)).cast("int").alias("rank"),
                     F.element_at(comp, F.col("event_type")).alias("component"), "value") \
             .filter(F.col("component").isNotNull())


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMPONENTS.items()) + " END"
SQL_LOG = f"""
lg AS (SELECT CAST(floor((epoch(ts) - {EPOCH0}) / 3600) + 1 AS BIGINT) AS step,
              CAST(user_id % {RANKS} AS INTEGER) AS rank, {_CASE} AS component, value
       FROM events WHERE {_CASE} IS NOT NULL),
rm AS (SELECT step, component, avg(value) AS mean_value, count(*) AS n_ranks FROM lg GROUP BY step, component)"""


def step_means(spark, sf):
    return rank_mean(loss_log(spark, sf), ["step", "component"])


register("rank_mean", f"""WITH {SQL_LOG}
SELECT step, component, round(mean_value, 6) AS mean_value, n_ranks FROM rm""")(
    lambda spark, sf: step_means(spark, sf).select("step", "component", F.round("mean_value", 6).alias("mean_value"),
                                                   "n_ranks"))


def q_total_loss(spark, sf):
    wide = step_means(spark, sf).groupBy("step").pivot("component", sorted(set(COMPONENTS.values()))) \
        .agg(F.first("mean_value"))
    t = total_loss(wide, tcm_weight=TCM_WEIGHT)
    return t.select("step", F.round("total", 6).alias("total"))


register("total_loss", f"""WITH {SQL_LOG},
w AS (SELECT step, max(CASE WHEN component = 'lm_1' THEN mean_value END) AS lm_1,
             max(CASE WHEN component = 'lm_2' THEN mean_value END) AS lm_2,
             max(CASE WHEN component = 'tcm' THEN mean_value END) AS tcm,
             max(CASE WHEN component = 'tlm' THEN mean_value END) AS tlm FROM rm GROUP BY step)
SELECT step, round(0.0 + coalesce(lm_1, 0.0) + coalesce(lm_2, 0.0) + {TCM_WEIGHT} * coalesce(tcm, 0.0)
                   + coalesce(tlm, 0.0), 6) AS total FROM w""")(q_total_loss)


def q_log_intervals(spark, sf):
    r = log_interval_losses(step_means(spark, sf), ["component"], "step", "mean_value", LOG_EVERY)
    return r.select("component", "interval", "logged_at_step", "loss")


register("log_intervals", f"""WITH {SQL_LOG}
, s AS (SELECT component, CAST(floor((step - 1) / {LOG_EVERY}) AS BIGINT) AS interval, sum(CAST(round(mean_value * 1e9) AS HUGEINT))::HUGEINT AS total
       FROM rm GROUP BY ALL),
l AS (SELECT *, least((interval + 1) * {LOG_EVERY}, (SELECT max(step) FROM rm)) AS logged_at_step FROM s),
p AS (SELECT *, 100000::HUGEINT * (logged_at_step - interval * {LOG_EVERY}) AS part FROM l)
SELECT component, interval, logged_at_step, CAST(sign(total) * ((2 * abs(total) + part) // (2 * part)) AS DOUBLE) / 10000 AS loss FROM p""")(q_log_intervals)
