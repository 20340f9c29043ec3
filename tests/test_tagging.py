from pyspark.sql import functions as F

from tessera.operators.tag_metrics import span_prf, spans
from tessera.operators.fragments import pack_fragments
from tessera.operators.tagging import (read_tagged, read_tokenized, realign, sentence_ids,
                                       tag_features, unk_tokens)


def test_greedy_packing_worked_case(spark):
    rows = [(0, i, n) for i, n in enumerate([3, 4, 2, 5, 1, 6])]
    df = spark.createDataFrame(rows, "sent long, line_no long, n_pieces int")
    got = [r["frag"] for r in pack_fragments(df, ["sent"], 8).orderBy("line_no").collect()]
    assert got == [0, 0, 1, 1, 1, 2]


def test_packing_never_exceeds_budget_and_realign_is_identity(spark):
    import random
    rnd = random.Random(5)
    rows = [(s, i, rnd.randint(1, 6), f"w{s}_{i}") for s in range(20) for i in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(rows, "sent long, line_no long, n_pieces int, token string")
    p = pack_fragments(df, ["sent"], 9, carry=["token"])
    assert all(r["s"] <= 9 for r in p.groupBy("sent", "frag").agg(F.sum("n_pieces").alias("s")).collect())
    preds = p.groupBy("sent", "frag").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x")) \
             .select("sent", "frag", F.transform("x", lambda z: z["token"]).alias("preds"))
    back = {r["sent"]: r["preds"] for r in realign(preds, p, ["sent"]).collect()}
    orig = {}
    for s, i, _, t in rows:
        orig.setdefault(s, []).append(t)
    assert back == orig


def test_raw_scan_and_sentence_ids(spark):
    lines = ["", "Paris B-LOC", "is O", "", "", "nice", "a b c", ""]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no long, text string")
    t = sentence_ids(read_tagged(df, "O"), ["file"]).filter(~F.col("is_blank"))
    got = [(r["token"], r["label"], r["sent_no"]) for r in t.orderBy("line_no").collect()]
    assert got == [("Paris", "B-LOC", 1), ("is", "O", 1), ("nice", "O", 3), ("a", "O", 3)]


def test_read_tokenized(spark):
    lines = ["-DOCSTART-", "", "Ann\tx\tB-PER", "runs", "", "", "Bob\tB-PER"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no long, text string")
    got = sorted((r["guid"], r["words"], r["labels"]) for r in read_tokenized(df, "en", ["file"]).collect())
    assert got == [("en-1", ["Ann", "runs"], ["B-PER", "O"]), ("en-2", ["Bob"], ["B-PER"])]


def test_unk_rule(spark):
    df = spark.createDataFrame([("abcdefghijklmnopq",), ("ab",)], "token string")
    got = [(r["token"], r["n_pieces"]) for r in unk_tokens(df, 6, 4, 3).collect()]
    assert got == [("<unk>", 1), ("ab", 1)]


def _spans(spark, labels):
    df = spark.createDataFrame([(0, i, l) for i, l in enumerate(labels)], "s long, pos long, label string")
    return sorted((r["span_type"], r["start"], r["end"]) for r in spans(df, ["s"]).collect())


def test_bio_spans(spark):
    assert _spans(spark, ["B-PER", "I-PER", "O", "I-LOC", "B-LOC", "B-LOC", "I-ORG"]) == [
        ("LOC", 3, 3), ("LOC", 4, 4), ("LOC", 5, 5), ("ORG", 6, 6), ("PER", 0, 1)]
    assert _spans(spark, ["I-PER", "I-PER"]) == [("PER", 0, 1)]


def test_pos_style_spans(spark):
    assert _spans(spark, ["NOUN", "NOUN", "VERB", "SCONJ", "SCONJ", "O"]) == [
        ("CONJ", 3, 3), ("CONJ", 4, 4), ("ERB", 2, 2), ("OUN", 0, 1)]


def test_span_prf(spark):
    g = spark.createDataFrame([(0, "PER", 0, 1), (0, "LOC", 3, 3)], "s long, span_type string, start long, end long")
    p = spark.createDataFrame([(0, "PER", 0, 1), (0, "LOC", 4, 4), (0, "ORG", 5, 5)],
                              "s long, span_type string, start long, end long")
    r = span_prf(g, p, ["s"]).first()
    assert (r["tp"], r["n_gold"], r["n_pred"]) == (1, 2, 3)
    assert abs(r["f1"] - 2 * (1 / 3) * 0.5 / (1 / 3 + 0.5)) < 1e-12


def test_tag_features_lengths(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 9], [1, -100, 2, 0, 1], 3)], "ids array<int>, labs array<int>, lang int")
    r = df.select(*tag_features(F.col("ids"), F.col("labs"), F.col("lang"), 6)).first()
    assert r["input_ids"] == [0, 5, 6, 7, 2, 2]
    assert r["label_ids"] == [-100, 1, -100, 2, -100, -100]
    assert all(len(r[c]) == 6 for c in ("input_ids", "input_mask", "segment_ids", "label_ids", "langs"))


def test_unknown_token_is_one_piece_with_its_own_id(spark):
    """A word no sequence can hold: one piece everywhere, so the fragment it
    was booked in holds it and keeps every later token's prediction."""
    from tessera.operators.tagging import realign
    from tessera.operators.vocab import UNK, UNK_ID, build_vocab, encode_word_arrays, word_pieces
    words = ["x" * 60, "abcd", "y" * 60, "efgh", "z" * 60]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "s int, line_no int, token string")
    u = unk_tokens(df, 16, 4, 3)
    assert [r["n_pieces"] for r in u.orderBy("line_no").collect()] == [1] * 5
    assert u.select(word_pieces(F.col("token"), 4).alias("p")).filter(F.col("p")[0] == UNK).distinct().collect()[0]["p"] == [UNK]
    vocab = build_vocab(u.select("token"), "token", 10, 4, pre_split=True)
    assert vocab.filter(F.col("piece") == UNK).count() == 1
    packed = pack_fragments(u, ["s"], 13, carry=["token"])
    frag = packed.groupBy("s", "frag").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("r")) \
        .select("s", "frag", F.transform("r", lambda r: r["token"]).alias("words"))
    ids = [r["ids"] for r in encode_word_arrays(frag, vocab, {"ids": "words"}, 4).collect()]
    assert len(ids) == 1 and len(ids[0]) == 5 and [i == UNK_ID for i in ids[0]] == [True, False, True, False, True]
    short = spark.createDataFrame([(1, 0, ["O", "O", "B"])], "s int, frag int, preds array<string>")
    row = realign(short, packed, ["s"]).collect()[0]
    assert row["tokens"] == [UNK, "abcd", UNK, "efgh", UNK] and row["preds"] == ["O", "O", "B", None, None]


def test_union_of_language_tables_by_name(spark):
    from tessera.operators.tagging import union_langs
    a = spark.createDataFrame([(1, "x")], "k int, w string")
    b = spark.createDataFrame([("y", 2, None)], "w string, k int, lang string")
    got = sorted(map(str, (tuple(r) for r in union_langs({"en": a, "de": b}).select("lang", "k", "w").collect())))
    assert got == ["('en', 1, 'x')", "(None, 2, 'y')"]
