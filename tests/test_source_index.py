import random
import re
import tempfile

from tessera.operators.retrieval import topk_indexed, topk_neighbours, write_source_index


def vectors(seed, n, dim=6):
    rnd = random.Random(seed)
    return [(i, [rnd.uniform(-1, 1) for _ in range(dim)] if i % 50 else None) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_indexed_search_equals_the_block_search(spark):
    src = spark.createDataFrame(vectors(1, 400), "idx long, vec array<double>")
    ask = spark.createDataFrame(vectors(2, 60), "idx long, vec array<double>")
    want = rows(topk_neighbours(ask, src, 4))
    for size in (1000, 37):
        index = write_source_index(src, f"file://{tempfile.mkdtemp()}/index", block_rows=size)
        assert rows(topk_indexed(ask, index, 4)) == want
    assert topk_indexed(ask.limit(0), index, 4).count() == 0
    empty = write_source_index(src.limit(0), f"file://{tempfile.mkdtemp()}/index")
    assert topk_indexed(ask, empty, 4).count() == 0


def test_sources_are_not_exchanged(spark):
    src = spark.createDataFrame(vectors(1, 400), "idx long, vec array<double>")
    index = write_source_index(src, f"file://{tempfile.mkdtemp()}/index", block_rows=50)
    for seed in (2, 3):          # two micro-batches
        batch = spark.createDataFrame(vectors(seed, 30), "idx long, vec array<double>")
        plan = topk_indexed(batch, index, 4)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
        assert sorted(exchanges) == ["block", "query_idx"]
        # the exchange by block belongs to the queries: the scan of the sources comes first, under a sort only
        assert plan.index("Bucketed: true") < plan.index("Exchange hashpartitioning(block")
