import re
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from conftest import clashing, read

from tessera.llm import collocations
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_collocations(rows, least=30, cover=80, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain.lower(text)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            for k in (1, 2, 3, 4):
                f[lang or "und" if lang is None else lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        longer = Counter()
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        for g, c in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i:i + m]] = max(longer[g[i:i + m]], c)
        rows = []
        for g, a in candidates.items():
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            if not (longer[g] and 100 * longer[g] >= cover * a):
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_collocations_equal_plain_counts(spark, sf):
    rows = [(r["lang"], r["text"]) for r in read(f"/root/testdata/{sf}/documents.parquet")]
    assert got(QUERIES["op11_phrase_collocations"](spark, f"/root/testdata/{sf}")) == plain_collocations(rows)


def test_lower_limits_and_ties(spark, small):
    rows = [(r["lang"], r["text"]) for r in small]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(collocations.collocations(docs, 3, 60, 50)) == plain_collocations(rows, 3, 60, 50)


def test_odd_rows(spark, odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert got(collocations.collocations(clashing(odd), 2)) == plain_collocations(rows, 2)
    assert collocations.collocations(empty).count() == 0


def test_control_characters_and_repeats(spark):
    texts = ["a a a a a, a\x01b \x01 a a", "é è. é è\té è\x0bé è", "x y z x y z"] * 3
    docs = spark.createDataFrame([(None, t) for t in texts] + [("und", "a a a")], "lang string, text string")
    assert got(collocations.collocations(docs, 1, 80, 2000)) == plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], 1)


@pytest.mark.parametrize("half", [1, 5, 17, 32, 40, 64])
def test_permutation_and_filter_lose_nothing(half):
    rng = np.random.default_rng(half)
    limit = np.uint64((1 << half) - 1)
    high, low = (rng.integers(0, 1 << 64, 5000, dtype=np.uint64) & limit for _ in range(2))
    mixed = collocations.permuted(high, low, half)
    assert (mixed[0] <= limit).all() and (mixed[1] <= limit).all()
    back = collocations.restored(*mixed, half)
    assert (back[0] == high).all() and (back[1] == low).all()
    layout = collocations.Layout(half, 3)
    h, l, count, place = collocations.tally(*mixed)
    assert (h[place] == mixed[0]).all() and (l[place] == mixed[1]).all() and count.sum() == 5000
    count = count * rng.choice([1, 254, 255, 100_000], len(count))
    shard, seen = layout.shard(h), []
    for s in np.unique(shard):
        mine = shard == s
        seen.append(layout.decode(int(s), *layout.encode(h[mine], l[mine], count[mine])))
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*seen), (h, l, count)))
