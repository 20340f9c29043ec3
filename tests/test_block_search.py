"""The search of a block: what single precision leaves out, copies, blocks by size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.pivots import _sent_queries, topk_pruned
from tessera.operators.retrieval import BlockSearch, _with_blocks, least_blocks, topk_neighbours

RNG = np.random.default_rng(5)


def unit(n, d=16):
    x = RNG.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(X, ids, Y, k):
    out = []
    for q, y in enumerate(Y):
        d = np.sqrt(np.cumsum((X - y) ** 2, axis=1)[:, -1])
        out += [(q, int(ids[j]), float(d[j])) for j in np.lexsort((ids, np.round(d, 9)))[:k]]
    return out


COPIED = unit(6000)
COPIED[500:4500] = COPIED[0]
CASES = {
    "directions": (unit(9000), unit(40)),
    "far from the origin": (unit(2500) + 1e6, unit(40) + 1e6),
    "ties": (RNG.integers(0, 3, (5000, 4)).astype(float), RNG.integers(0, 3, (40, 4)).astype(float)),
    "copies": (COPIED, np.concatenate([COPIED[:3], unit(20)])),
    "huge": (unit(300) * 1e25, unit(10) * 1e25),
    "few": (unit(3), unit(4)),
}


@pytest.mark.parametrize("case", CASES)
def test_block_search_equals_all_distances(case):
    X, Y = CASES[case]
    ids = RNG.permutation(len(X))
    got = BlockSearch(ids, X, 7).run(np.arange(len(Y)), Y).sort_values(["query_idx", "dist9", "neighbour_idx"])
    assert [tuple(r) for r in got[["query_idx", "neighbour_idx", "dist"]].itertuples(index=False)] == plain(X, ids, Y, 7)


def vectors(spark, x):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(x.tolist())], "g string, idx long, vec array<double>")


def test_blocks_follow_the_size_of_vectors(spark):
    src, ask = vectors(spark, unit(9000, 4)), vectors(spark, unit(50, 4))
    for groups in ([], ["g"]):
        asked, found = _with_blocks(ask, src, groups, "vec", None, 1)
        assert asked.first()["__xn"] == 1 and found.first()["__yn"] == 1       # 288 KB of vectors: no copies
        assert _with_blocks(ask, src, groups, "vec", 4096, 1)[0].first()["__xn"] == 3


def test_random_directions_are_sent_once_per_shelf(spark):
    src, ask = vectors(spark, unit(2000)), vectors(spark, unit(150))
    _, sent, cells, _ = _sent_queries(ask, src, 5, "idx", "vec", [], 20)
    shelves = cells.select("shelf").distinct().count()
    assert cells.count() >= 100 and shelves <= least_blocks(spark) + 1
    assert sent.count() <= 150 * shelves
    assert sorted(topk_pruned(ask, src, 5, block_rows=20).collect()) == sorted(topk_neighbours(ask, src, 5).collect())


def test_pruned_search_far_from_the_origin(spark):
    src, ask = vectors(spark, unit(1500, 6) + 1e5), vectors(spark, unit(60, 6) + 1e5)
    got, want = (sorted(df.withColumn("distance", F.round("distance", 5)).collect())
                 for df in (topk_pruned(ask, src, 5, block_rows=40), topk_neighbours(ask, src, 5)))
    assert got == want
