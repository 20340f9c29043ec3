"""Columns of the caller with the names of helper columns come back unchanged."""
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, lines, mixing, simhash, toxicity
from tessera.llm.common import own_names

HELPERS = ["__id", "__hash", "__keep", "__s", "__z", "__cut", "__src", "__size", "__copies", "__u", "__group", "__page0", "__sha", "__again", "__gone", "__guess",
           "own0", "ownown0"]


def steps(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)], "doc_id long, toxic int")
    return {
        "near_dedup": lambda d: simhash.near_dedup(d), "exact_dedup": lambda d: exact_dedup.exact_dedup(d), "mixed": lambda d: mixing.mixed(d),
        "dedup_lines": lambda d: lines.dedup_lines(d), "with_language": lambda d: langid.with_language(d, langid.train(d)),
        "with_toxicity": lambda d: toxicity.with_toxicity(d, toxicity.train(d, labels))}


@pytest.mark.parametrize("name", ["near_dedup", "exact_dedup", "mixed", "dedup_lines", "with_language", "with_toxicity"])
def test_helper_names_pass_through(spark, odd, name):
    docs = odd.filter("length(text) < 100 or text is null")
    step = steps(spark)[name]
    named = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in HELPERS})
    out, bare = step(named), step(docs)
    assert out.columns == named.columns + [c for c in bare.columns if c not in docs.columns]
    rows = out.collect()
    for r in rows:
        for c in HELPERS:
            assert r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}"
    assert sorted(str(tuple(r[c] for c in bare.columns)) for r in rows) == sorted(str(tuple(r)) for r in bare.collect())


def test_only_taken_names_step_aside(spark):
    seen = []
    step = own_names(lambda d: seen.append(d.columns) or d)
    df = spark.createDataFrame([(1, 2, 3)], "__a int, own0 int, b int")
    assert step(df).columns == ["__a", "own0", "b"] and seen == [["ownown0", "own0", "b"]]
