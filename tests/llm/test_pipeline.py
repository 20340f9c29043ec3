import plain
from conftest import clashing

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stage_names_and_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "packing"]
    assert P.ORACLE_SQL is None


def test_every_stage_takes_odd_and_empty_tables(spark, odd, empty):
    for name, step in P.STAGES:
        for df in (odd, empty, clashing(odd)):
            out = step(spark, df, SF)
            rows = out.collect()
            if name != "packing":
                assert out.columns == df.columns, name
            if df is empty:
                assert not rows


def test_run_against_the_plain_stages(spark, small):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.identify_language(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in small if any(c.isalpha() for c in r["text"] or "")}
    once = P.drop_exact_copies(spark, kept, SF)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(x[0] for x in plain.exact(rows) if x[3])
    lone = P.drop_near_copies(spark, once, SF)
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert sorted(r["doc_id"] for r in lone.collect()) == sorted({c for _, _, c in plain.near_classes(rows)})
    mixed = P.mix_sources(spark, lone, SF)
    total = sum(plain.words(r["text"]) for r in lone.collect())
    assert abs(sum(plain.words(r["text"]) for r in mixed.collect()) - 1.5 * total) < 0.01 * total
    packed = P.run(spark, SF)
    ids = mixed.groupBy("doc_id").count().withColumnRenamed("count", "copies")
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("t"), F.max("doc_tokens").alias("d"))
    assert tokens.join(ids, "doc_id", "full").filter("t is null or copies is null or t <> d * copies").count() == 0
