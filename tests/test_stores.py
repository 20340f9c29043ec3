import math
import random

from pyspark.sql import functions as F

from tessera.operators.retrieval import topk_neighbours
from tessera.operators.runs import best_run, training_run_name
from tessera.sources.stores import (cached_features, cached_tokens, layers_complete, read_layer, store_exists, write_layers,
                                    write_predictions)


def test_token_cache_builds_once_and_again_on_overwrite(spark, tmp_path):
    path, calls = str(tmp_path / "tokens"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("en", len(calls), ["a", "b"])], "lang string, idx int, tokens array<string>")

    assert cached_tokens(spark, path, build).first()["idx"] == 1
    assert cached_tokens(spark, path, build).first()["idx"] == 1 and len(calls) == 1
    assert cached_tokens(spark, path, build, overwrite=True).first()["idx"] == 2 and len(calls) == 2


def test_layer_store_is_reused_only_when_complete_and_prunes(spark, tmp_path):
    path = str(tmp_path / "layers")
    assert not store_exists(spark, path) and not layers_complete(spark, path, 3)
    rows = [(i, layer, [float(i * layer)]) for i in range(4) for layer in range(3)]
    write_layers(spark.createDataFrame(rows, "idx long, layer int, vec array<double>"), path)
    assert layers_complete(spark, path, 3) and not layers_complete(spark, path, 4)
    one = read_layer(spark, path, total_layers=3, num_layers=2, index=1)
    assert sorted(r["vec"][0] for r in one.collect()) == [0.0, 2.0, 4.0, 6.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "PushedFilters: []" in plan


def test_predictions_round_trip_by_language(spark, tmp_path):
    path = str(tmp_path / "pred")
    rows = [("eng_Latn", 1, [3, 4]), ("rus_Cyrl", 2, [5]), ("eng_Latn", 2, [])]
    write_predictions(spark.createDataFrame(rows, "lang string, query_idx long, neighbours array<long>"), path)
    back = spark.read.parquet(path).select("lang", "query_idx", "neighbours").collect()
    assert sorted((r[0], r[1], list(r[2])) for r in back) == sorted(rows)
    assert (tmp_path / "pred" / "lang=rus_Cyrl").is_dir()


def test_topk_by_group_equals_brute_force_with_uneven_groups(spark):
    rnd = random.Random(4)
    rows = [(g, i, [rnd.gauss(0, 1) for _ in range(4)]) for g, n in (("a", 60), ("b", 7), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, idx long, vec array<double>")
    got = topk_neighbours(df, df, 3, group_cols=["lang"], block_rows=8, min_blocks=1).collect()
    want = set()
    for g, i, v in rows:
        near = sorted((round(math.dist(v, w), 9), j) for h, j, w in rows if h == g)[:3]
        want |= {(g, i, r + 1, j) for r, (_, j) in enumerate(near)}
    assert {(r["lang"], r["query_idx"], r["rank"], r["neighbour_idx"]) for r in got} == want and len(got) == len(want)


def test_best_run_default_and_ties(spark):
    h = spark.createDataFrame([("x", 1, 0.5, 100), ("x", 2, 0.7, 200), ("x", 3, 0.7, 300), ("y", 1, 0.0, 100)],
                              "run string, n int, f1 double, step int")
    got = {r["run"]: (r["best_step"], r["best_f1"]) for r in best_run(h, "run", "n", "f1", "step", 0.0, -1).collect()}
    assert got == {"x": (200, 0.7), "y": (-1, 0.0)}
    none = best_run(h, "run", "n", "f1", "step").filter("run = 'y'").first()
    assert none["best_step"] is None and none["best_f1"] == 0.0


def test_training_run_name(spark):
    cols = ["file", "loss", "lm", "con", "tlm", "cls", "w", "cos", "t", "smooth", "reset"]
    rows = [("data/pairs_with_latin/x/train.csv", "TCM", True, True, False, True, 0.5, True, 0.25, False, False),
            ("data/plain/x/train.csv", "TLM", False, True, True, False, 1.0, False, 1.0, True, True),
            ("data/plain/x/train.csv", "TCM", True, False, False, False, 1.0, False, 1.0, False, False)]
    df = spark.createDataFrame(rows, cols)
    got = [r[0] for r in df.select(training_run_name(F.lit("out"), *[F.col(c) for c in cols])).collect()]
    assert got == ["out_pairs_with_latin_TCM_with_latn_cls_weight_0.5_cosine_0.25",
                   "out_plain_TLM_no_lm_tlm_smoothed_reset_pos", "out_plain_TCM_no_contrast"]


def test_feature_cache_builds_only_missing_partitions(spark, tmp_path):
    path, built = str(tmp_path / "features"), []

    def keys(*langs, max_len=8):
        return spark.createDataFrame([("test", lang, "m", max_len) for lang in langs], "mode string, lang string, model string, max_len int")

    def build(missing):
        built.append(sorted((r["lang"] or "", r["max_len"]) for r in missing.collect()))
        rows = missing.filter("lang is null or lang <> 'none'")
        return rows.withColumn("ids", F.array(F.lit(len(built)), F.length(F.coalesce("lang", F.lit("")))))

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "features" / "data").rglob("*.parquet")}

    def read(wanted, **kw):
        return sorted((r["lang"] or "", r["max_len"], list(r["ids"])) for r in cached_features(spark, path, wanted, build, **kw).collect())

    assert read(keys("en", "de", None)) == [("", 8, [1, 0]), ("de", 8, [1, 2]), ("en", 8, [1, 2])]
    first = files()
    assert read(keys("en", None)) == [("", 8, [1, 0]), ("en", 8, [1, 2])] and files() == first and len(built) == 1
    assert read(keys("en", "fr")) == [("en", 8, [1, 2]), ("fr", 8, [2, 2])] and built[1] == [("fr", 8)]
    added = set(files()) - set(first)
    assert all("lang=fr" in str(p) for p in added) and {p: t for p, t in files().items() if p in first} == first
    assert read(keys("en", max_len=16)) == [("en", 16, [3, 2])] and read(keys("none")) == [] and read(keys("none")) == [] and len(built) == 4
    assert read(keys("en"), overwrite=True) == [("en", 8, [5, 2])] and read(keys("de")) == [("de", 8, [1, 2])]
