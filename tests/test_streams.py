"""The stream tracker counts evaluations in event order, however they are
dealt over files and triggers."""

import datetime as dt
import random
import tempfile

import pytest

from tessera.streaming.streams import best_tracker, run_to_files

SCHEMA = "run string, ts timestamp, event_id long, f1 double"


def expected(rows, patience):
    out = []
    for run in sorted({r[0] for r in rows}):
        best, misses = 0.0, 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == run), key=lambda r: r[1:3]), 1):
            best, misses = (r[3], 0) if r[3] > best else (best, misses + 1)
            out.append((run, n, r[3], best, misses, misses > patience))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 3])
def test_best_tracker_any_trigger(spark, files):
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice("ab"), start + dt.timedelta(hours=h, minutes=rnd.choice((0, 30))), i, rnd.randrange(40) / 10)
            for i, h in enumerate(rnd.choices(range(72), k=90))]
    path = tempfile.mkdtemp(prefix="tessera-stream-")
    for day in range(3):        # days arrive in order, rows of a day in any order over two files
        mine = [r for r in rows if (r[1] - start).days == day]
        rnd.shuffle(mine)
        for part in (mine[::2], mine[1::2]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    end = [("end", start + dt.timedelta(days=6), 0, 0.0)]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    out = run_to_files(best_tracker(stream, 3, "1 day"), tempfile.mkdtemp(prefix="tessera-stream-") + "/out")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == expected(rows, 3)


def test_staged_arrivals_keep_rows_without_a_group(spark, tmp_path):
    from tessera.streaming.streams import stage_files
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "k int, g string")
    assert sorted(r["k"] for r in spark.read.parquet(stage_files(df, "g", str(tmp_path / "in"))).collect()) == [1, 2, 3, 4]
