"""Streaming queries: the driver tables are staged as successive file
arrivals under the checkpoint folder, a stream runs over them with
``availableNow``, and the sink is read back as a table.

Oracles compare with the batch semantics: stateless streams equal the batch
query; windowed means cover the windows closed by the final watermark;
the state tracker equals the batch running best / misses, with an end marker
arriving last so that the watermark passes every evaluation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.q_corpus import SQL_VALID
from tessera.plans.q_losses import COMPONENTS
from tessera.plans.q_retrieval import SQL_TOPK, K, sources, targets
from tessera.plans.q_runs import PATIENCE
from tessera.plans.registry import register, table
from tessera.streaming.streams import (best_tracker, dedup_stream, loss_windows, pair_stream, run_to_files,
                                       scratch, stage_files, start_topk_stream)

WINDOW, WATERMARK, FILES_PER_TRIGGER = "1 day", "1 hour", 8
DEDUP_WATERMARK = "10 minutes"
BEST_WATERMARK, END_MARKER = "1 day", "end of stream"


def _stream(spark, path, schema, files=FILES_PER_TRIGGER):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def q_stream_pairs(spark, sf):
    d = table(spark, sf, "documents")
    src = stage_files(d.withColumn("__g", F.pmod("doc_id", F.lit(4))), "__g", scratch(spark, "docs"))
    out = run_to_files(pair_stream(_stream(spark, src, d.schema)), scratch(spark, "pairs"))
    return spark.read.parquet(out).select("doc_id", "line_no", "text", "transliteration")


register("stream_pairs", f"""WITH {SQL_VALID}
SELECT doc_id, line_no, text, transliteration FROM vp""")(q_stream_pairs)


def _events_staged(spark, sf, marker=None, files=FILES_PER_TRIGGER):
    """The events as arriving days; ``marker``: event type of one last row,
    three days after all others."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src = stage_files(e.withColumn("__day", F.to_date("ts")), "__day", scratch(spark, "events"))
    if marker:
        last = e.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
        end = last.select(*[F.col("ts") if f.name == "ts" else
                            F.lit(marker if f.name == "event_type" else None).cast(f.dataType).alias(f.name)
                            for f in e.schema.fields])
        end.withColumns({"event_id": F.lit(0).cast(e.schema["event_id"].dataType),
                         "value": F.lit(0).cast(e.schema["value"].dataType)}).write.mode("append").parquet(src)
    return _stream(spark, src, e.schema, files)


def q_stream_loss_windows(spark, sf):
    ev = _events_staged(spark, sf)
    comp = F.create_map(*[x for k, v in COMPONENTS.items() for x in (F.lit(k), F.lit(v))])
    log = ev.select("ts", F.element_at(comp, F.col("event_type")).alias("component"), "value") \
            .filter(F.col("component").isNotNull())
    out = run_to_files(loss_windows(log, "ts", WINDOW, WATERMARK, ["component"]), scratch(spark, "windows"))
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").cast("string").alias("window_start"),
                    "component", F.round("mean_value", 6).alias("mean_value"), "n")


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMPONENTS.items()) + " END"
register("stream_loss_windows", f"""
WITH l AS (SELECT ts, {_CASE} AS component, value FROM events WHERE {_CASE} IS NOT NULL),
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
g AS (SELECT date_trunc('day', ts) AS ws, component, avg(value) AS mean_value, count(*) AS n FROM l GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, component, round(mean_value, 6) AS mean_value, n
FROM g, wm WHERE ws + INTERVAL 1 DAY <= wm.wm""")(q_stream_loss_windows)


def q_stream_best(spark, sf, files=FILES_PER_TRIGGER):
    ev = _events_staged(spark, sf, END_MARKER, files)
    evals = ev.select(F.col("event_type").alias("run"), "ts", "event_id", (F.floor("value") / 100).alias("f1"))
    out = run_to_files(best_tracker(evals, PATIENCE, BEST_WATERMARK), scratch(spark, "best"))
    return spark.read.parquet(out)


register("stream_best", f"""
WITH h AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS eval_no,
                  floor(value) / 100 AS f1 FROM events),
fl AS (SELECT *, greatest(coalesce(max(f1) OVER (PARTITION BY run ORDER BY eval_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS best_before FROM h),
isl AS (SELECT *, f1 > best_before AS improved,
               sum(CAST(f1 > best_before AS INTEGER)) OVER (PARTITION BY run ORDER BY eval_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM fl),
ms AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY eval_no)
                 - CASE WHEN island > 0 THEN 1 ELSE 0 END AS misses FROM isl)
SELECT run, CAST(eval_no AS BIGINT) AS eval_no, CAST(f1 AS DOUBLE) AS f1,
       CAST(greatest(best_before, f1) AS DOUBLE) AS best_so_far, CAST(misses AS BIGINT) AS misses,
       {PATIENCE} > 0 AND misses > {PATIENCE} AS stopped
FROM ms""")(q_stream_best)


def q_stream_topk(spark, sf):
    y = targets(spark, sf)
    src = stage_files(y.withColumn("__g", F.pmod("idx", F.lit(4))), "__g", scratch(spark, "queries"))
    out = start_topk_stream(_stream(spark, src, spark.read.parquet(src).schema), sources(spark, sf), K,
                            scratch(spark, "topk"))
    return spark.read.parquet(out).select("query_idx", "rank", "neighbour_idx", "distance")


register("stream_topk", SQL_TOPK)(q_stream_topk)


def q_stream_dedup(spark, sf):
    ev = _events_staged(spark, sf)
    out = run_to_files(dedup_stream(ev, "ts", DEDUP_WATERMARK, ["user_id", "event_type"]), scratch(spark, "dedup"))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


register("stream_dedup")(q_stream_dedup)


