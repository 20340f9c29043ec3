import random

from pyspark.sql import functions as F

from tessera.operators.pooling import mean_pool
from tessera.operators.retrieval import retrieval_acc, topk_neighbours, topk_neighbours_sql


def test_unit_square_distances(spark):
    src = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])],
                                "idx long, vec array<double>")
    q = spark.createDataFrame([(0, [0.1, 0.0])], "idx long, vec array<double>")
    got = [(r["rank"], r["neighbour_idx"]) for r in topk_neighbours(q, src, 4).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_ties_go_to_lower_index(spark):
    src = spark.createDataFrame([(5, [1.0, 0.0]), (2, [-1.0, 0.0]), (9, [0.0, 1.0])], "idx long, vec array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "idx long, vec array<double>")
    got = [r["neighbour_idx"] for r in topk_neighbours(q, src, 3).orderBy("rank").collect()]
    assert got == [2, 5, 9]


def test_block_topk_equals_direct_for_any_block_count(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    src = spark.createDataFrame(rows, "idx long, vec array<double>")
    q = spark.createDataFrame(rows[::3], "idx long, vec array<double>")
    direct = sorted(tuple(r) for r in topk_neighbours_sql(q, src, 5).collect())
    for b in (1, 3, 7):
        got = sorted(tuple(r) for r in topk_neighbours(q, src, 5, block_rows=10_000, min_blocks=b).collect())
        assert got == direct


def test_acc_monotone(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    src = spark.createDataFrame(rows, "idx long, vec array<double>")
    q = spark.createDataFrame([(i, [x + rnd.gauss(0, 0.8) for x in v]) for i, v in rows], "idx long, vec array<double>")
    r = retrieval_acc(topk_neighbours(q, src, 10), q).first()
    assert 0 <= r["acc1"] <= r["acc5"] <= r["acc10"] <= 1 and r["n_queries"] == 60


def test_mean_pool_and_zero_mask(spark):
    t = spark.createDataFrame([(1, 0, 0, [1.0, 2.0], 1), (1, 0, 1, [3.0, 4.0], 1), (1, 0, 2, [9.0, 9.0], 0),
                               (2, 0, 0, [5.0, 5.0], 0)],
                              "sent_id long, layer int, pos int, vec array<double>, m int")
    got = {r["sent_id"]: r["p"] for r in mean_pool(t, {"p": "m"}).collect()}
    assert got[1] == [2.0, 3.0] and got[2] is None
