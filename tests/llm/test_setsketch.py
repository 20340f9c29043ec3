import numpy as np
import plain
import pytest
from conftest import clashing, read

from tessera.llm import setsketch
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_sets(rows, width=5):
    out = []
    for i, t in rows:
        w = plain.WORD.findall(plain.lower(t).encode())
        out.append((i, frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def plain_classes(rows, percent=85):
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), c := least.get(find(a)), i == c) for a, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_classes_equal_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(f"/root/testdata/{sf}/documents.parquet")]
    assert got(QUERIES["op12_setsketch_neardup"](spark, f"/root/testdata/{sf}")) == plain_classes(rows)


def test_odd_rows(spark, odd, empty):
    assert got(setsketch.near_classes(clashing(odd))) == plain_classes([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert setsketch.near_classes(empty).count() == 0


@pytest.mark.parametrize("tile", [1 << 20, 1500])
def test_chains_and_groups_of_near_copies(spark, tile):
    """Texts of a common base with more and more words replaced: many pairs
    near the threshold, chains whose ends are far apart, and a passage that
    dissimilar texts share."""
    rng = np.random.default_rng(2)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(120)]
        for _ in range(40):
            words = list(words)
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 1 << 30)}"
            rows.append(list(words))
    for i in range(120):
        rows.append(passage + [f"q{i}y{j}" for j in range(rng.integers(2, 20))])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(setsketch.near_classes(docs, tile=tile)) == plain_classes(rows)


def test_registers_are_mergeable_and_estimate_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:])
    marks = setsketch.registers([a, b, np.union1d(a, b)], 2000)
    assert (np.maximum(marks[0], marks[1]) == marks[2]).all()
    n_a, n_b = np.array([len(a)]), np.array([len(b)])
    assert setsketch.plausible(marks[:1], marks[1:2], n_a, n_b, 50).all()          # 1500 of 3000 in common
    assert not setsketch.plausible(marks[:1], marks[1:2], n_a, n_b, 75).any()


def test_bands_find_pairs_at_the_threshold():
    """Share of pairs of exactly 0.85 that share a band and pass the likelihood."""
    rng = np.random.default_rng(6)
    seen = 0
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = pool[:185], np.concatenate([pool[15:]])
        marks = setsketch.registers([np.unique(a), np.unique(b)])
        bands = (marks[0].reshape(setsketch.BANDS, -1) == marks[1].reshape(setsketch.BANDS, -1)).all(axis=1).any()
        seen += bool(bands and setsketch.plausible(marks[:1], marks[1:], np.array([185]), np.array([185]))[0])
    assert seen == 200
