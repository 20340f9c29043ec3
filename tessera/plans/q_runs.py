"""Run bookkeeping queries.

* checkpoints: one name per ``part`` row — ``checkpoint-<5-digit step>``,
  with the base model ``checkpoint-0``, names without the prefix and
  non-numeric suffixes mixed in;
* languages: ``nation`` names as ``<name>_Latn``; the parallel-file listing
  misses some source files (n % 5 = 4) and English pair files (n % 7 = 6);
* evaluation histories: ``events`` per event type as a run, in (ts,
  event_id) order, f1 = floor(value) / 100 (ties happen).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.draws import sql_key, sql_uniform, uniform
from tessera.operators.report import metric_report
from tessera.operators.runs import (best_run, dev_summary, early_stop, epoch_stats, pending_runs, read_langs,
                                    resolve_parallel, run_matrix, run_name, running_best, select_checkpoints,
                                    sequence_numbers, training_run_name)
from tessera.plans.registry import register, table

LO, HI = 0, 50000
TRAIN_LANGS, N_SEEDS, BASE_SEED, BASE_MODEL = ["eng_Latn", "deu_Latn", "spa_Latn"], 5, 42, "base-model"
DONE_P, DONE_SEED, TASK, PIVOT = 0.3, 31, "bible", "eng_Latn"
TARGETS = ["eng_Latn", "nation_3_Latn"]
PATIENCE = 3


def checkpoints(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = (F.when(k == 0, F.lit("checkpoint-0"))
            .when(k % 10 == 0, F.concat(F.lit("ckpt-"), k.cast("string")))
            .when(k % 7 == 0, F.concat(F.lit("checkpoint-x"), k.cast("string")))
            .otherwise(F.concat(F.lit("checkpoint-"), F.lpad((k * 100).cast("string"), 5, "0"))))
    return p.select(name.alias("name"))


SQL_CK = f"""
ck AS (SELECT CASE WHEN p_partkey = 0 THEN 'checkpoint-0'
                   WHEN p_partkey % 10 = 0 THEN 'ckpt-' || CAST(p_partkey AS VARCHAR)
                   WHEN p_partkey % 7 = 0 THEN 'checkpoint-x' || CAST(p_partkey AS VARCHAR)
                   ELSE 'checkpoint-' || lpad(CAST(p_partkey * 100 AS VARCHAR), 5, '0') END AS name FROM part),
cs AS (SELECT name, TRY_CAST(split_part(name, '-', 2) AS INTEGER) AS step FROM ck),
cf AS (SELECT * FROM cs WHERE contains(name, 'checkpoint') AND step BETWEEN {LO} AND {HI})"""

register("checkpoint_filter", f"WITH {SQL_CK} SELECT name, step FROM cf")(
    lambda spark, sf: select_checkpoints(checkpoints(spark, sf), LO, HI).select("name", "step"))


def runs(spark, sf):
    r = run_matrix(select_checkpoints(checkpoints(spark, sf), LO, HI), TRAIN_LANGS, N_SEEDS, BASE_SEED, BASE_MODEL)
    return r.withColumn("run_name", run_name([F.lit("ner"), "train_lang", F.col("step").cast("string"),
                                               F.col("seed").cast("string")]))


_LANGS = "[" + ", ".join(f"'{x}'" for x in TRAIN_LANGS) + "]"
SQL_RUNS = SQL_CK + f""",
rm AS (SELECT name, step, unnest({_LANGS}) AS train_lang FROM cf),
rs AS (SELECT name, step, train_lang, CAST(unnest(range({BASE_SEED}, {BASE_SEED + N_SEEDS})) AS INTEGER) AS seed FROM rm),
runs AS (SELECT *, CASE WHEN name = 'checkpoint-0' THEN '{BASE_MODEL}' ELSE name END AS model_ref,
                concat_ws('_', 'ner', train_lang, CAST(step AS VARCHAR), CAST(seed AS VARCHAR)) AS run_name FROM rs)"""

register("run_matrix", f"WITH {SQL_RUNS} SELECT name, step, train_lang, seed, model_ref, run_name FROM runs")(
    lambda spark, sf: runs(spark, sf).select("name", "step", "train_lang", "seed", "model_ref", "run_name"))


def q_pending(spark, sf):
    r = runs(spark, sf)
    done = r.filter(uniform(F.lit(DONE_SEED), F.col("run_name")) < DONE_P).select("run_name")
    return pending_runs(r, done, ["run_name"]).select("run_name", "model_ref")


register("pending_runs", f"""WITH {SQL_RUNS},
done AS (SELECT run_name FROM runs WHERE {sql_uniform(sql_key(str(DONE_SEED), 'run_name'))} < {DONE_P})
SELECT run_name, model_ref FROM runs ANTI JOIN done USING (run_name)""")(q_pending)


def nation_langs(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lower("n_name"), F.lit("_Latn")).alias("lang"),
                                             "n_nationkey")


def file_listing(spark, sf):
    n = nation_langs(spark, sf)
    own = n.filter(F.col("n_nationkey") % 5 != 4).select(
        F.format_string(f"{TASK}.%s-{PIVOT}.%s", F.col("lang"), F.col("lang")).alias("file_name"))
    eng = n.filter(F.col("n_nationkey") % 7 != 6).select(
        F.format_string(f"{TASK}.%s-{PIVOT}.{PIVOT}", F.col("lang")).alias("file_name"))
    return own.unionByName(eng)


def q_parallel_files(spark, sf):
    langs, files = nation_langs(spark, sf).select("lang"), file_listing(spark, sf)
    out = None
    for t in TARGETS:
        r = resolve_parallel(langs, files, TASK, t, PIVOT)
        out = r if out is None else out.unionByName(r)
    return out.select("src_lang", "tgt_lang", "src_file", "tgt_file")


def _sql_resolve(t):
    tgt_file = (f"'{TASK}.' || lang || '-{PIVOT}.{PIVOT}'" if t == PIVOT else f"'{TASK}.{t}-{PIVOT}.{t}'")
    return f"""SELECT lang AS src_lang, '{t}' AS tgt_lang, '{TASK}.' || lang || '-{PIVOT}.' || lang AS src_file,
       {tgt_file} AS tgt_file FROM nl WHERE lang <> '{t}'"""


register("parallel_files", f"""
WITH nl AS (SELECT lower(n_name) || '_Latn' AS lang, n_nationkey FROM nation),
fl AS (SELECT '{TASK}.' || lang || '-{PIVOT}.' || lang AS file_name FROM nl WHERE n_nationkey % 5 <> 4
       UNION ALL SELECT '{TASK}.' || lang || '-{PIVOT}.{PIVOT}' FROM nl WHERE n_nationkey % 7 <> 6),
c AS ({" UNION ALL ".join(_sql_resolve(t) for t in TARGETS)})
SELECT src_lang, tgt_lang, src_file, tgt_file FROM c
WHERE src_file IN (SELECT file_name FROM fl) AND tgt_file IN (SELECT file_name FROM fl)""")(q_parallel_files)


def q_lang_list(spark, sf):
    lines = table(spark, sf, "nation").select(
        F.concat_ws("\t", F.col("n_name"), (F.col("n_regionkey") % 2).cast("string")).alias("text"))
    return read_langs(lines)


register("lang_list", "SELECT split_part(n_name || chr(9) || CAST(n_regionkey % 2 AS VARCHAR), chr(9), 1) AS lang "
                      "FROM nation")(q_lang_list)


def history(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("run"), "ts", "event_id", "value")
    h = sequence_numbers(e, "run", [F.col("ts"), F.col("event_id")])
    return h.select("run", F.col("eval_no").cast("int").alias("eval_no"),
                    (F.floor("value") / 100).alias("f1"), "value", "ts") \
            .withColumn("global_step", F.col("eval_no") * 100)


SQL_HIST = """
h AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS eval_no,
             floor(value) / 100 AS f1, value, ts FROM events),
hs AS (SELECT *, eval_no * 100 AS global_step FROM h)"""

# The run SILENT never scores above the start value: it keeps the default step.
SILENT, DEFAULT_STEP = "error", -1


def silenced(spark, sf):
    return history(spark, sf).withColumn("f1", F.when(F.col("run") == SILENT, F.lit(0.0)).otherwise(F.col("f1")))


SQL_BEST = SQL_HIST + f""",
hz AS (SELECT * REPLACE (CASE WHEN run = '{SILENT}' THEN 0.0 ELSE f1 END AS f1) FROM hs),
b AS (SELECT run, coalesce(arg_max(global_step, (f1, -eval_no)) FILTER (f1 > 0), {DEFAULT_STEP}) AS best_global_step,
             coalesce(max(f1) FILTER (f1 > 0), 0.0) AS best_f1 FROM hz GROUP BY run)"""

register("best_checkpoint", f"WITH {SQL_BEST} SELECT run, best_global_step, best_f1 FROM b")(
    lambda spark, sf: best_run(silenced(spark, sf), "run", "eval_no", "f1", "global_step", 0.0, DEFAULT_STEP))


_SQL_FLAGS = """
fl AS (SELECT *, greatest(coalesce(max(f1) OVER (PARTITION BY run ORDER BY eval_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {s}), {s}) AS best_before FROM hs),
fi AS (SELECT *, f1 > best_before AS improved FROM fl)"""

register("early_stop", f"""WITH {SQL_HIST}, {_SQL_FLAGS.format(s='0.0')},
isl AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run ORDER BY eval_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM fi),
ms AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY eval_no)
                 - CASE WHEN island > 0 THEN 1 ELSE 0 END AS misses FROM isl),
st AS (SELECT run, min(eval_no) AS stop_at FROM ms WHERE {PATIENCE} > 0 AND misses > {PATIENCE} GROUP BY run)
SELECT r.run, st.stop_at FROM (SELECT DISTINCT run FROM hs) r LEFT JOIN st ON r.run = st.run""")(
    lambda spark, sf: early_stop(history(spark, sf), PATIENCE))

register("running_best", f"""WITH {SQL_HIST}, {_SQL_FLAGS.format(s='-1.0')}
SELECT run, eval_no, f1, improved, greatest(best_before, f1) AS best_so_far FROM fi""")(
    lambda spark, sf: running_best(history(spark, sf), order="eval_no")
    .select("run", "eval_no", "f1", "improved", "best_so_far"))


def q_epoch_stats(spark, sf):
    h = history(spark, sf).withColumn("epoch", F.to_date("ts"))
    r = epoch_stats(h, ["run", "epoch"], "value")
    return r.select("run", F.col("epoch").cast("string").alias("epoch"), "n",
                    *[F.round(c, 6).alias(c) for c in ("mean_value", "min_value", "max_value")])


register("epoch_stats", f"""WITH {SQL_HIST}
SELECT run, CAST(CAST(ts AS DATE) AS VARCHAR) AS epoch, count(*) AS n, round(avg(value), 6) AS mean_value,
       round(min(value), 6) AS min_value, round(max(value), 6) AS max_value
FROM hs GROUP BY run, CAST(ts AS DATE)""")(q_epoch_stats)


def q_dev_summary(spark, sf):
    h = silenced(spark, sf)
    best = best_run(h, "run", "eval_no", "f1", "global_step", 0.0, DEFAULT_STEP) \
        .withColumnRenamed("best_global_step", "best_checkpoint")
    return dev_summary(h, "run", "global_step", ["f1", "value"], best)


register("dev_summary", f"""WITH {SQL_BEST}
SELECT run, CAST(global_step AS VARCHAR) || '_f1' AS key, CAST(f1 AS DOUBLE) AS value FROM hz
UNION ALL SELECT run, CAST(global_step AS VARCHAR) || '_value', CAST(value AS DOUBLE) FROM hz
UNION ALL SELECT run, 'best_checkpoint', CAST(best_global_step AS DOUBLE) FROM b
UNION ALL SELECT run, 'best_f1', CAST(best_f1 AS DOUBLE) FROM b""")(q_dev_summary)


def q_metric_report(spark, sf):
    h = history(spark, sf)
    m = h.groupBy("run").agg(F.avg("f1").alias("mean_f1"), F.max("f1").alias("max_f1"),
                             F.count(F.lit(1)).cast("double").alias("n_evals"))
    long = m.select(F.col("run").alias("lang"), F.explode(F.array(
        *[F.struct(F.lit(k).alias("metric"), F.format_string("%.4f", F.col(k)).alias("value"))
          for k in ("mean_f1", "max_f1", "n_evals")])).alias("kv")).select("lang", "kv.metric", "kv.value")
    return metric_report(long)


register("metric_report", f"""WITH {SQL_HIST},
m AS (SELECT run AS lang, avg(f1) AS mean_f1, max(f1) AS max_f1, CAST(count(*) AS DOUBLE) AS n_evals FROM hs GROUP BY run),
l AS (SELECT lang, 'max_f1' AS metric, printf('%.4f', max_f1) AS value FROM m
      UNION ALL SELECT lang, 'mean_f1', printf('%.4f', mean_f1) FROM m
      UNION ALL SELECT lang, 'n_evals', printf('%.4f', n_evals) FROM m)
SELECT lang, '=====================' || chr(10) || 'language=' || lang || chr(10)
             || string_agg(metric || ' = ' || value, chr(10) ORDER BY metric) AS report
FROM l GROUP BY lang""")(q_metric_report)


# Training parameters: one row per part, every switch read from a bit of its key.
def _bit(i):
    return F.shiftright("p_partkey", i).bitwiseAND(F.lit(1)) == 1


def q_run_name(spark, sf):
    p = table(spark, sf, "part")
    file = F.concat(F.lit("corpus/"), F.lower("p_brand"), F.when(_bit(8), F.lit("_with")).otherwise(F.lit("")),
                    F.lit("/pairs/train.csv"))
    name = training_run_name(
        F.lit("out/run"), file, F.when(_bit(0), F.lit("TCM")).otherwise(F.lit("TLM")), ~_bit(1), _bit(2), _bit(3), _bit(4),
        (F.col("p_size") % 10) / 4, _bit(5), (F.col("p_size") % 7 + 1) / 8, _bit(6), _bit(7))
    return p.select("p_partkey", name.alias("run_name"))


def _sql_bit(i):
    return f"(p_partkey >> {i}) & 1 = 1"


register("run_name", f"""
WITH f AS (SELECT *, 'corpus/' || lower(p_brand) || CASE WHEN {_sql_bit(8)} THEN '_with' ELSE '' END || '/pairs/train.csv' AS file,
                  CASE WHEN {_sql_bit(0)} THEN 'TCM' ELSE 'TLM' END AS loss FROM part)
SELECT p_partkey, 'out/run_' || split_part(file, '/', -3) || '_' || loss
       || CASE WHEN contains(file, 'with') THEN '_with_latn' ELSE '' END
       || CASE WHEN loss <> 'TCM' THEN '' WHEN {_sql_bit(2)} THEN
            CASE WHEN {_sql_bit(4)} THEN '_cls' ELSE '_pool' END || '_weight_' || CAST((p_size % 10) / 4 AS VARCHAR)
          ELSE '_no_contrast' END
       || CASE WHEN {_sql_bit(1)} THEN '_no_lm' ELSE '' END || CASE WHEN {_sql_bit(3)} THEN '_tlm' ELSE '' END
       || CASE WHEN {_sql_bit(5)} THEN '_cosine_' || CAST((p_size % 7 + 1) / 8 AS VARCHAR) ELSE '' END
       || CASE WHEN {_sql_bit(6)} THEN '_smoothed' ELSE '' END
       || CASE WHEN {_sql_bit(7)} THEN '_reset_pos' ELSE '' END AS run_name
FROM f""")(q_run_name)
