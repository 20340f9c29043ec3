import math

from pyspark.sql import functions as F

from tessera.operators.batching import assign_batches, pad_batch
from tessera.operators.cls_metrics import accuracy, batch_mean_loss, macro_f1, parse_topics_headerless
from tessera.operators.encode import mlm_mask, pair_encode, tlm_concat
from tessera.operators.losses import contrastive_loss, interleave, masked_nll
from tessera.operators.runs import best_run, early_stop, select_checkpoints
from tessera.operators.vocab import build_vocab, encode_texts


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, "abcdef ab", "ab")], "k long, text string, transliteration string")
    v = build_vocab(df, ["text", "transliteration"], 10, 4)
    ids = {r["piece"]: r["piece_id"] for r in v.collect()}
    assert ids["<s>"] == 0 and ids["▁ab"] == 5  # most frequent piece first after the specials
    e = encode_texts(df, v, {"i1": "text", "i2": "transliteration"}, 4)
    r = pair_encode(e, ["k"], F.col("i1"), F.col("i2"), 4).first()
    assert r["input_ids_1"] == [0, ids["▁abcd"], ids["ef"], 2]
    assert r["special_tokens_mask_1"] == [1, 0, 0, 1] and r["attention_mask_2"] == [1, 1, 1]


def test_mlm_never_masks_specials(spark):
    df = spark.createDataFrame([(k, [0] + list(range(10, 40)) + [2]) for k in range(50)], "k long, ids array<int>")
    df = df.withColumn("sp", F.transform("ids", lambda x, i: F.when((i == 0) | (i == F.size("ids") - 1), 1).otherwise(0)))
    inp, lab = mlm_mask(F.col("ids"), F.col("sp"), [F.col("k")], 7, 100, 0.5)
    rows = df.select("ids", inp.alias("inp"), lab.alias("lab")).collect()
    n_masked = 0
    for r in rows:
        assert r["lab"][0] == -100 and r["lab"][-1] == -100 and r["inp"][0] == 0 and r["inp"][-1] == 2
        for x, i, l in zip(r["ids"], r["inp"], r["lab"]):
            assert l in (-100, x)
            n_masked += l != -100
    assert 0.4 < n_masked / (50 * 30) < 0.6


def test_tlm_concat_drops_second_begin(spark):
    df = spark.createDataFrame([(1, [0, 5, 2], [1, 1, 1], [1, 0, 1], [0, 0, 0], [0, 7, 8, 2], [1, 1, 1, 1],
                                 [1, 0, 0, 1], [0, 0, 0, 0])],
                               "k long, input_ids_1 array<int>, attention_mask_1 array<int>, "
                               "special_tokens_mask_1 array<int>, token_type_ids_1 array<int>, "
                               "input_ids_2 array<int>, attention_mask_2 array<int>, "
                               "special_tokens_mask_2 array<int>, token_type_ids_2 array<int>")
    r = tlm_concat(df, ["k"], 6, seed=1).first()
    exp = [0, 5, 2, 7, 8, 2] if r["tlm_order"] == 1 else [0, 7, 8, 2, 5, 2]
    assert r["input_ids_tlm"] == exp


def test_batches_and_padding(spark):
    df = spark.createDataFrame([(i, list(range(i % 5 + 1))) for i in range(10)], "k long, ids array<int>")
    b = assign_batches(df, [F.col("k")], 4)
    assert sorted((r["k"], r["batch_id"]) for r in b.collect()) == [(i, i // 4) for i in range(10)]
    p = pad_batch(b, "batch_id", {"ids": 1}, "ids", multiple_of=8).collect()
    assert all(len(r["ids"]) == 8 for r in p)


def test_macro_f1_union_of_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "gold int, pred int")
    r = macro_f1(df).first()
    # class 0: f1 = 2*1/(2+1); class 1: 2*1/(1+3); class 2: 0
    assert abs(r["macro_f1"] - (2 / 3 + 0.5 + 0) / 3) < 1e-12 and r["n_classes"] == 3
    assert accuracy(df).first()["accuracy"] == 0.5


def test_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [0.0, 0.0]), (1, 1, [0.0, math.log(3.0)])],
                               "batch_id long, gold int, logits array<double>")
    # batch 0: ln 2; batch 1: (ln 2 + ln(4/3)) / 2
    exp = (math.log(2) + (math.log(2) + math.log(4 / 3)) / 2) / 2
    assert abs(batch_mean_loss(df).first()["mean_loss"] - exp) < 1e-12


def test_contrastive_single_pair_is_zero(spark):
    p = spark.createDataFrame([(0, 0, [1.0, 0.0], [0.0, 1.0])], "b long, pos long, v1 array<double>, v2 array<double>")
    r = contrastive_loss(interleave(p, "b", "pos", "v1", "v2"), 0.1, batch="b").first()
    assert abs(r["loss"]) < 1e-12


def test_masked_nll(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([5.0, 1.0], -100)], "logits array<double>, label int")
    r = masked_nll(df).first()
    assert r["n_masked"] == 1 and abs(r["nll"] - math.log(2)) < 1e-12


def test_checkpoint_selection(spark):
    names = ["checkpoint-0", "checkpoint-01000", "checkpoint-x5", "ckpt-2000", "checkpoint-3000", "checkpoint-9"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(r["name"] for r in select_checkpoints(df, 0, 3000).collect())
    assert got == ["checkpoint-0", "checkpoint-01000", "checkpoint-3000", "checkpoint-9"]


def test_best_first_on_tie_and_early_stop(spark):
    h = spark.createDataFrame([("r", i, f) for i, f in enumerate([0.5, 0.7, 0.7, 0.6, 0.7, 0.65, 0.8], 1)],
                              "run string, eval_no int, f1 double")
    b = best_run(h, "run", "eval_no", "f1", "eval_no").first()
    assert b["best_eval_no"] == 7
    h2 = h.filter("eval_no < 7")
    assert best_run(h2, "run", "eval_no", "f1", "eval_no").first()["best_eval_no"] == 2
    assert early_stop(h, 3).first()["stop_at"] == 6
    assert early_stop(h, 4).first()["stop_at"] is None
    assert early_stop(h, 0).first()["stop_at"] is None


def test_headerless_topics(spark):
    df = spark.createDataFrame([("1\tFaith\tv",), ("2\tSin",), ("3\ta\tb\tc",)], "text string")
    got = sorted(tuple(r) for r in parse_topics_headerless(df).collect())
    assert got == [("1", "Faith", "v"), ("2", "Sin", "nan")]


def test_two_level_running_max_and_numbering(spark):
    import random
    from pyspark.sql import Window
    from tessera.operators.runs import running_max, sequence_numbers
    rnd = random.Random(2)
    rows = [(r, t, rnd.randint(0, 50) / 10) for r in ("a", "b") for t in rnd.sample(range(1000), 40)]
    df = sequence_numbers(spark.createDataFrame(rows, "run string, t int, f1 double"), "run", [F.col("t")])
    w = Window.partitionBy("run").orderBy("t")
    assert sorted((r["run"], r["t"], r["eval_no"]) for r in df.collect()) == \
        sorted((r["run"], r["t"], r["n"]) for r in df.select("run", "t", F.row_number().over(w).alias("n")).collect())
    for inclusive in (True, False):
        got = running_max(df, "run", "eval_no", "f1", "m", inclusive=inclusive, block=3)
        wf = Window.partitionBy("run").orderBy("eval_no").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        exp = got.withColumn("e", F.max("f1").over(wf))
        assert all(r["m"] == r["e"] for r in exp.collect())


def test_topic_rows_have_exactly_the_asked_length(spark):
    from tessera.operators.encode import as_text, topic_encode
    df = spark.createDataFrame([(1, list(range(10, 15))), (2, []), (3, list(range(10, 200)))], "k int, ids array<int>")
    for r in df.select("k", *topic_encode(F.col("ids"), 100), *topic_encode(F.col("ids"), 160)).collect():
        for n in (100, 160):
            ids, mask = r[f"input_ids_{n}"], r[f"attention_mask_{n}"]
            size = min(n, {1: 5, 2: 0, 3: 190}[r["k"]] + 2)
            assert len(ids) == len(mask) == n and sum(mask) == size
            assert ids[0] == 0 and ids[size - 1] == 2 and set(ids[size:]) <= {1}
    texts = spark.createDataFrame([("a",), (None,)], "t string").select(as_text(F.col("t")).alias("t"))
    assert sorted(r["t"] for r in texts.collect()) == ["a", "nan"]
