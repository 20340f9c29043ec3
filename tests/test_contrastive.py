import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.draws import normal
from tessera.operators.losses import contrastive_loss, normal_vectors


def plain(rows, temperature, cosine=False, extra=()):
    def unit(v):
        return [x / math.sqrt(sum(y * y for y in v)) for x in v] if cosine else v
    rows, extra = {i: unit(v) for i, v in rows}, [unit(v) for v in extra]
    nll = []
    for i, a in rows.items():
        s = {j: sum(x * y for x, y in zip(a, b)) / temperature for j, b in rows.items() if j != i}
        if i ^ 1 in s:
            others = [sum(x * y for x, y in zip(a, b)) / temperature for b in extra]
            nll.append(math.log(sum(math.exp(x) for x in [*s.values(), *others])) - s[i ^ 1])
    return 0.5 * sum(nll) / len(nll)


def vectors(seed, n, dim=5):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


def test_loss_equals_the_sum_over_pairs(spark):
    groups = {"a": vectors(1, 8), "b": vectors(2, 2), "c": vectors(3, 7)}           # in c the last has no partner
    df = spark.createDataFrame([(b, i, v) for b, rows in groups.items() for i, v in rows], "batch_id string, i int, vec array<double>")
    for cosine in (False, True):
        got = {r["batch_id"]: (r["loss"], r["n_vectors"]) for r in contrastive_loss(df, 0.3, cosine).collect()}
        for b, rows in groups.items():
            assert math.isclose(got[b][0], plain(rows, 0.3, cosine), rel_tol=1e-9) and got[b][1] == len(rows)


def test_negatives_are_the_draws_of_the_column_function(spark):
    t = spark.range(6).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: normal(F.lit(9), F.lit("b7"), F.col("id"), d)))
    want = [r["v"] for r in t.orderBy("id").collect()]
    assert np.allclose(normal_vectors(9, "b7", 6, 4), want, rtol=1e-12)
    df = spark.createDataFrame([("b7", i, v) for i, v in vectors(4, 4, 4)], "batch_id string, i long, vec array<double>")
    got = contrastive_loss(df, 0.5, True, negatives=1.5, seed=9).first()["loss"]
    assert math.isclose(got, plain(vectors(4, 4, 4), 0.5, True, want), rel_tol=1e-9)


def test_odd_batches_and_plan(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (None, 0, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (3, 0, None), (3, 1, [1.0, 1.0])],
                               "batch_id int, i int, vec array<double>")
    got = {r["batch_id"]: (r["loss"], r["n_vectors"]) for r in contrastive_loss(df, 1.0, True).collect()}
    assert got == {1: (None, 2), None: (0.0, 2), 3: (None, 2)}
    plan = contrastive_loss(df, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert contrastive_loss(df.limit(0), 1.0).count() == 0
