import random

import numpy as np
import pytest

from tessera.operators.fragments import leave, pack_fragments


def plain(sizes, budget):
    count, frag, pos, out = 0, 0, -1, []
    for n in sizes:
        if pos >= 0 and count + n > budget:
            frag, pos, count = frag + 1, 0, n
        else:
            pos, count = pos + 1, count + n
        out.append((frag, pos))
    return out


@pytest.mark.parametrize("block", [3, 10, 1 << 16])
def test_packing_equals_the_loop_for_any_block(spark, block):
    rnd = random.Random(block)
    rows, want = [], {}
    for s in range(60):
        key = (None if s % 9 == 0 else f"f{s % 4}", s)
        start = rnd.randint(0, 40)
        sizes = [rnd.choice([0, 1, 1, 2, 3, 5, 9, 15]) for _ in range(rnd.choice([1, 2, 7, 60]))]
        rows += [(*key, start + i, n, f"t{i}") for i, n in enumerate(sizes)]
        want |= {(*key, start + i): fp for i, fp in enumerate(plain(sizes, 12))}
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, sent int, line_no long, n_pieces int, token string")
    got = pack_fragments(df, ["file", "sent"], 12, carry=["token"], block=block).collect()
    assert len(got) == len(rows)
    assert {(r["file"], r["sent"], r["line_no"]): (r["frag"], r["pos"]) for r in got} == want
    sizes = {(r[0], r[1], r[2]): (r[3], r[4]) for r in rows}
    assert all((r["n_pieces"], r["token"]) == sizes[r["file"], r["sent"], r["line_no"]] for r in got)


def test_a_long_sentence_is_spread_over_tasks(spark):
    n, budget = 1_000_000, 253
    df = spark.range(n, numPartitions=8).selectExpr("1 AS s", "id AS line_no", "cast(1 + pmod(xxhash64(id), 9) AS int) AS n_pieces")
    out = pack_fragments(df, ["s"], budget)
    rows = out.selectExpr("line_no", "n_pieces", "frag", "pos").toPandas().sort_values("line_no")
    want = plain(rows["n_pieces"].tolist(), budget)
    assert rows["frag"].tolist() == [f for f, _ in want] and rows["pos"].tolist() == [p for _, p in want]
    held = out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < n


def test_block_functions_compose():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(0, 16, rng.integers(2, 80))
        cut = int(rng.integers(1, len(sizes)))
        whole, one, two = (leave(x, 12) for x in (sizes, sizes[:cut], sizes[cut:]))
        for c in range(14):
            def go(table, pieces, opened):
                at = min(pieces, 13)
                return (table[0][at], opened + table[2][at]) if table[2][at] else (pieces + table[0][at], opened)
            assert go(two, *go(one, c, 0)) == go(whole, c, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "s int, line_no long, n_pieces int")
    assert pack_fragments(df, ["s"], 5).count() == 0
