import random

from pyspark.sql import functions as F

from tessera.operators.pivots import planned_visits, topk_pruned
from tessera.operators.retrieval import topk_neighbours

SCHEMA = "g string, idx long, vec array<double>"


def clustered(seed, n, centres, dim=8, spread=0.02):
    rnd = random.Random(seed)
    mid = [[random.Random(i).gauss(0, 1) for _ in range(dim)] for i in range(centres)]
    return [(None if i % 7 == 0 else "a", i, [x + rnd.gauss(0, spread) for x in mid[i % centres]]) for i in range(n)]


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_same_rows_as_the_block_search(spark):
    src = spark.createDataFrame(clustered(1, 900, 12) + [("a", 5000, None), ("b", 1, [0.0] * 8)], SCHEMA)
    ask = spark.createDataFrame(clustered(2, 200, 12) + [("b", 2, [1.0] * 8), ("lone", 3, [1.0] * 8)], SCHEMA)
    for block in (1000, 40):
        assert rows(topk_pruned(ask, src, 5, group_cols=["g"], block_rows=block)) == rows(topk_neighbours(ask, src, 5, group_cols=["g"]))


def test_ties_repeats_and_small_cells(spark):
    rnd = random.Random(3)
    src = spark.createDataFrame([("a", i, [float(rnd.randint(0, 2)), float(rnd.randint(0, 2))]) for i in range(300)], SCHEMA)
    ask = spark.createDataFrame([("a", i, [float(i % 4), 1.0]) for i in range(30)], SCHEMA)
    assert rows(topk_pruned(ask, src, 7, block_rows=5)) == rows(topk_neighbours(ask, src, 7))
    assert topk_pruned(ask, src.limit(0), 3).count() == 0 and topk_pruned(ask.limit(0), src, 3).count() == 0


def test_clustered_vectors_visit_few_cells_and_copy_only_queries(spark):
    src = spark.createDataFrame(clustered(4, 3000, 30), SCHEMA)
    ask = spark.createDataFrame(clustered(5, 600, 30), SCHEMA)
    first, visits, cells, celled = planned_visits(ask, src, 5, block_rows=50)
    n_cells, n_visits = cells.count(), visits.count()
    assert n_cells >= 50 and celled.count() == 3000                       # no source is copied
    assert (600 + n_visits) / 600 <= 0.25 * n_cells                       # copies of a query, against one per cell
    assert visits.select("cell").distinct().count() <= n_cells
