import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import clashing

from tessera.llm import spelling
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_near(words):
    """Words that share a string after dropping one letter of either or both, each pair compared."""
    by = defaultdict(set)
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by[v].add(w)
    return {w: {x for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for x in by[v] if one_edit(w, x)} for w in words}


def plain_variants(rows):
    n = plain_counts(rows)
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_variants_equal_plain_search(spark, sf):
    from conftest import read
    rows = [(r["doc_id"], r["text"]) for r in read(f"{sf}/documents.parquet")]
    assert got(QUERIES["op13_spelling_variants"](spark, sf)) == plain_variants(rows)


def test_small_parts_and_blocks_change_nothing(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(spelling.variants(docs, part_letters=300, block=70)) == plain_variants(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(spelling.variants(clashing(odd), 1, 1)) is not None
    assert got(spelling.variants(clashing(odd))) == plain_variants(rows)
    assert spelling.variants(empty).count() == 0


def test_long_words_chains_and_ties(spark):
    long = "abcdefghij" * 30
    words = ["graph"] * 3 + ["graphs"] * 6 + ["graphsy"] * 12 + ["grbph"] * 3 + ["grcph"] * 3
    words += [long] * 3 + [long + "k"] * 6 + [long[:150] + "x" + long[151:]] * 3 + ["y" * 63] * 3 + ["y" * 64] * 6 + ["y" * 65] * 12
    words += ["Ünïön"] * 3 + ["ÜnïöN×"] * 6
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(None, None), (None, "")], "doc_id long, text string")
    assert got(spelling.variants(docs)) == plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_index_finds_all_words_one_edit_away():
    rng = np.random.default_rng(5)
    for letters, length in (("ab", 6), ("abcde", 5), ("aé", 9)):
        words = sorted({"".join(rng.choice(list(letters), rng.integers(1, length + 1))) for _ in range(300)})
        index = spelling.Vocabulary(words)
        for size in {len(w) for w in words}:
            asked = [w for w in words if len(w) == size] + ["z" * size]
            q, w = index.near(asked)
            assert {(asked[a], words[b]) for a, b in zip(q, w)} == {(a, b) for a in asked for b in words if one_edit(a, b)}
