"""Structured Streaming versions of the incremental work.

Each builder takes a streaming DataFrame and returns a streaming DataFrame
(or starts a ``foreachBatch`` query), reusing the batch operators, so batch
and stream compute the same thing:

* :func:`pair_stream` — new lines in, valid pairs out (stateless);
* :func:`loss_windows` — loss means per component and event-time window,
  late rows bounded by a watermark;
* :func:`best_tracker` — live best score / patience per run in event-time
  order, whatever the arrival order within the watermark
  (``applyInPandasWithState``: state = best, misses, evaluations seen and
  the evaluations the watermark has not passed yet);
* :func:`start_topk_stream` — new queries scored against a source index,
  written once, in every micro-batch;
* :func:`dedup_stream` — exact-duplicate suppression within the watermark.

Sinks are files under the shared checkpoint folder (never the driver's
memory sink), with a checkpoint location per query so a restarted query
resumes exactly once.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.pairs import make_pairs, valid_pairs
from tessera.operators.retrieval import topk_indexed, write_source_index
from tessera.session import checkpoint_dir
from tessera.sources.lines import lines_of


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def pair_stream(docs: DataFrame) -> DataFrame:
    """Documents stream → valid transliteration pairs (same functions as the
    batch pair generation)."""
    lines = lines_of(docs, "text", ["doc_id", "lang", "source"], unicode_breaks=True)
    return valid_pairs(make_pairs(lines))


def loss_windows(log: DataFrame, ts: str, window: str, watermark: str, keys: list[str],
                 value: str = "value") -> DataFrame:
    """Mean and count per key and tumbling event-time window; rows later
    than the watermark are dropped (append mode emits closed windows)."""
    return (log.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), *keys)
            .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                    "mean_value", "n"))


BEST_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("eval_no", T.LongType()),
    T.StructField("f1", T.DoubleType()), T.StructField("best_so_far", T.DoubleType()),
    T.StructField("misses", T.LongType()), T.StructField("stopped", T.BooleanType())])
BEST_STATE = "best double, misses long, seen long, at array<long>, no array<long>, f1 array<double>"


def best_tracker(evals: DataFrame, patience: int, watermark: str, run: str = "run", ts: str = "ts",
                 number: str = "event_id", score: str = "f1", start: float = 0.0) -> DataFrame:
    """Per run, in event order (``ts``, then ``number``): best score so far
    (strict improvement over ``start``), consecutive misses, and whether
    patience is exhausted.

    An evaluation is counted once the watermark has passed it, so files that
    arrive out of order (by less than the watermark delay) and the size of a
    micro-batch do not change the result. Until then it waits in the state,
    which so holds a run's evaluations of one watermark delay; an event-time
    timer releases them. Evaluations later than the watermark are dropped."""
    def fn(key, pdfs, state):
        best, misses, seen, at, no, f1 = state.get if state.exists else (start, 0, 0, [], [], [])
        waiting = [pd.DataFrame({"us": at, "no": no, "f1": f1})]
        if not state.hasTimedOut:
            waiting += [pd.DataFrame({"us": p["us"], "no": p[number], "f1": p[score]}) for p in pdfs]
        rows = pd.concat([w for w in waiting if len(w)]).sort_values(["us", "no"], kind="mergesort")
        closed = rows["us"] // 1000 < state.getCurrentWatermarkMs()
        out = []
        for value in rows.loc[closed, "f1"].to_numpy():
            seen += 1
            if value > best:
                best, misses = float(value), 0
            else:
                misses += 1
            out.append((key[0], seen, float(value), best, misses, bool(patience > 0 and misses > patience)))
        rest = rows[~closed]
        state.update((best, misses, seen, rest["us"].astype("int64").tolist(), rest["no"].astype("int64").tolist(),
                      rest["f1"].astype("float64").tolist()))
        if len(rest):
            state.setTimeoutTimestamp(int(rest["us"].iloc[0] // 1000))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in BEST_SCHEMA.fields])

    timed = evals.withColumn("us", F.unix_micros(ts)).withWatermark(ts, watermark)
    return timed.groupBy(run).applyInPandasWithState(fn, BEST_SCHEMA, BEST_STATE, "append",
                                                     GroupStateTimeout.EventTimeTimeout)


def dedup_stream(df: DataFrame, ts: str, watermark: str, keys: list[str]) -> DataFrame:
    """Drop rows whose key was already seen within the watermark delay."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def run_to_files(stream: DataFrame, out: str, mode: str = "append") -> str:
    """Run a stream to completion over what is available (``availableNow``)
    into a parquet sink with its own checkpoint location."""
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return out


def start_topk_stream(queries: DataFrame, sources: DataFrame, k: int, out: str, block_rows: int = 4096) -> str:
    """Score every micro-batch of new queries against the static sources with
    the exact top-k. The sources are indexed once, before the first
    micro-batch, and every micro-batch reads the index by block. Each
    micro-batch overwrites its own ``batch_id=<n>`` folder, so a retried batch
    replaces rather than duplicates its output (idempotent sink)."""
    index = write_source_index(sources, out + "-index", block_rows=block_rows)

    def each(batch: DataFrame, batch_id: int):
        topk_indexed(batch, index, k).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (queries.writeStream.foreachBatch(each).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stage_files(df: DataFrame, split_col: str, out: str) -> str:
    """Write ``df`` group by group (distinct ``split_col`` values in order) so a
    file stream sees the groups as successive arrivals (rows without a value
    come first). Each group is written with its own parallelism; only the group values (days, buckets:
    a small, checked number) reach the driver. A simulation aid for the
    driver tables: a production stream comes from its upstream source."""
    vals = [r[0] for r in df.select(split_col).distinct().orderBy(split_col).limit(10_001).collect()]
    if len(vals) > 10_000:
        raise ValueError("too many arrival groups")
    for v in vals:
        df.filter(F.col(split_col).eqNullSafe(F.lit(v))).drop(split_col).write.mode("append").parquet(out)
    return out
