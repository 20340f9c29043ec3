import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators.tag_metrics import STRICT, array_spans, find_spans, prf, span_counts, span_prf, spans

TAGS = ["O", "B-PER", "I-PER", "I-LOC", "B-LOC", "E-PER", "S-LOC", "B", "I", ".", "X-A-B", ""]


def plain(labels, strict=False):
    """Token by token."""
    out, begin, was, had = [], 0, "O", "_"
    for i, label in enumerate([x or "O" for x in labels] + ["O"]):
        tag, typ = label[:1], label[1:].split("-", 1)[-1] or "_"
        if was in ("E", "S") or (was in ("B", "I") and tag in ("B", "S", "O")) or (was not in ("O", ".") and had != typ):
            if not strict or labels[begin] == f"B-{had}" and all(x == f"I-{had}" for x in labels[begin + 1:i]):
                out.append((had, begin, i - 1))
        if tag in ("B", "S") or (was in ("E", "S", "O") and tag in ("E", "I")) or (tag not in ("O", ".") and had != typ):
            begin = i
        was, had = tag, typ
    return out


def sentences(seed, n=400):
    rnd = random.Random(seed)
    return [[rnd.choice(TAGS[:5] if i % 2 else TAGS) for _ in range(rnd.choice([0, 1, 5, 12]))] for i in range(n)]


def test_find_spans_equals_the_token_loop():
    for seed, strict in ((1, False), (2, True)):
        rows = [x for x in sentences(seed) if "" not in x]
        row, kind, start, end, types = find_spans(pa.array(rows, pa.list_(pa.string())), STRICT if strict else "conll")
        got = sorted((int(r), types[k], int(s), int(e)) for r, k, s, e in zip(row, kind, start, end))
        assert got == sorted((i, *x) for i, labels in enumerate(rows) for x in plain(labels, strict))


def test_nulls_and_empty_rows(spark):
    df = spark.createDataFrame([(1, ["B-X", None, "I-X"]), (2, None), (3, []), (4, ["I-X"])], "k int, l array<string>")
    got = {r["k"]: [tuple(x) for x in r["s"]] for r in df.select("k", array_spans(F.col("l")).alias("s")).collect()}
    assert got == {1: [("X", 0, 0), ("X", 2, 2)], 2: [], 3: [], 4: [("X", 0, 0)]}


def test_counts_equal_the_join_of_spans(spark):
    gold, rnd = [x for x in sentences(5) if "" not in x], random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None]), g, [t if rnd.random() < 0.7 else rnd.choice(TAGS[:5]) for t in g]) for i, g in enumerate(gold)]
    df = spark.createDataFrame(rows, "s int, lang string, gold array<string>, pred array<string>").repartition(3)
    for mode in ("conll", STRICT):
        got = {r["lang"]: (r["n_gold"], r["n_pred"], r["tp"]) for r in prf(span_counts(df, "gold", "pred", ["lang"], mode)).collect()}
        for lang in ("a", "b", None):
            mine = [r for r in rows if r[1] == lang]
            g = {(r[0], *x) for r in mine for x in plain(r[2], mode == STRICT)}
            p = {(r[0], *x) for r in mine for x in plain(r[3], mode == STRICT)}
            assert got[lang] == (len(g), len(p), len(g & p))
    side = [spans(df.select("s", F.posexplode(c).alias("pos", "label")), ["s"]) for c in ("gold", "pred")]
    want = span_prf(*side, ["s"]).first().asDict()
    assert prf(span_counts(df, "gold", "pred")).first().asDict() == want


def test_only_counts_are_shuffled(spark):
    df = spark.createDataFrame([("a", ["B-X"], ["B-X"])], "lang string, g array<string>, p array<string>")
    plan = span_counts(df, "g", "p", ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
