import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.arrays import argmax
from tessera.functions.draws import uniform, uniforms
from tessera.operators.fragments import pack_fragments
from tessera.operators.subword import _Chunks
from tessera.operators.tag_arrays import SLICE, drop_lines, lists, only, slices, spelled, token_rows, written
from tessera.operators.tag_metrics import spans
from tessera.operators.tagging import align_labels, assemble_sentences, decode_predictions, feature_labels, read_tagged, realign, sentence_ids, unk_tokens
from tessera.operators.vocab import encode_texts, encode_word_arrays, piece_cutter, word_counts, word_pieces


def _tokens(spark):
    files = spark.createDataFrame([("f", ["a\tB-X", "", "bcdefgh\tO", "c\tI-X"]), ("g", []), ("h", None), ("i", ["", ""])], "file string, text array<string>")
    t = sentence_ids(read_tagged(files), ["file"])
    return drop_lines(only(t, [c for c in t.columns if c != "n_fields"]), "is_blank", ["sent_no", "token", "label"], "line_no")


def _workers(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow"), plan.count("ArrowEvalPython")


def test_passes_that_follow_one_another_share_a_worker(spark):
    t = _tokens(spark)
    packed = pack_fragments(unk_tokens(t, 6, 4, 3, original="original"), ["file", "sent_no"], 3, carry=["token", "label", "original"])
    rows = token_rows(packed, [c for c in packed.columns if c != "file"])
    s = assemble_sentences(t, ["file", "sent_no"], "line_no", {"label": "label", "line_no": "line_no"})
    found = spans(s, ["file", "sent_no"], pos_col="line_no")
    assert _workers(t) == _workers(rows) == _workers(found) == (1, 0)
    assert sorted(map(tuple, rows.select("line_no", "sent_no", "token", "label", "n_pieces", "frag", "pos").collect())) == [
        (0, 0, "a", "B-X", 1, 0, 0), (2, 1, "bcdefgh", "O", 2, 0, 0), (3, 1, "c", "I-X", 1, 0, 1)]
    assert sorted(map(tuple, found.collect())) == [("f", 0, "X", 0, 0), ("f", 1, "X", 3, 3)]


def test_a_frame_between_passes_starts_anew(spark):
    t = _tokens(spark).withColumn("file", F.concat("file", F.lit("!")))
    got = token_rows(only(t, ["file", "token"]), ["token"])
    assert sorted(map(tuple, got.collect())) == [("f!", "a"), ("f!", "bcdefgh"), ("f!", "c")]


def test_slices_are_bounded_and_whole():
    texts = ["x" * n for n in [10, 3 * SLICE, 0, 5] + [SLICE // 50] * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(slices(batch))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert len(parts) > 8 and all(p.nbytes <= SLICE or len(p) == 1 for p in parts)


VOCAB = [("<unk>", 3, True), ("▁abcd", 5, False), ("ef", 6, False), ("▁x", 7, False)]


def test_rows_are_encoded_without_moving_them_one_by_one(spark):
    vocab = spark.createDataFrame(VOCAB, "piece string, piece_id int, is_special boolean")
    df = spark.createDataFrame([(1, ["abcdef", "x", "zz"], "x abcd"), (2, [], "  "), (3, None, None), (4, ["<unk>", "x"], "abcdefghij")], "k int, w array<string>, t string")
    out = encode_word_arrays(df, vocab, {"ids": "w"}, 4)
    assert out.columns == ["k", "w", "t", "ids"]
    got = {r["k"]: (r["w"], r["t"], r["ids"]) for r in out.collect()}
    assert got == {1: (["abcdef", "x", "zz"], "x abcd", [5, 6, 7, 3]), 2: ([], "  ", []), 3: (None, None, None), 4: (["<unk>", "x"], "abcdefghij", [3, 7])}
    texts = {r["k"]: r["ids"] for r in encode_texts(df.select("k", "t"), vocab, {"ids": "t"}, 4).collect()}
    assert texts == {1: [7, 5], 2: [], 3: None, 4: [5, 3, 3]}
    # the row that moves is a chunk, and goes into the worker that a later pass uses
    staged = spark.read.parquet(*[f for f in out.inputFiles() if "word-chunks" in f])
    assert staged.columns == ["chunk", "rows", "units"] and "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    assert "_passed" in out.__dict__


def test_a_chunk_is_smaller_than_its_rows():
    words = pa.array([[f"word{i % 50}" for i in range(k, k + 80)] for k in range(1000)])
    rows = pa.RecordBatch.from_arrays([pa.array(range(1000)), words], ["k", "w"])
    chunk = _Chunks(["k"], ["w"], {"ids": "w"}, piece_cutter(4)).chunk(rows, 0)
    assert len(chunk) == 1 and chunk.nbytes < rows.nbytes / 5
    assert sorted(chunk["units"][0].as_py()) == sorted({"▁word", *(str(i) for i in range(50))})


def test_pieces_are_counted_by_task(spark):
    df = spark.createDataFrame([(f"abcdef x{i % 3}",) for i in range(2000)], "t string").coalesce(1)
    part = word_counts(df, ["t"], piece_cutter(4))
    assert {r["word"]: r["n"] for r in part.collect()} == {"▁abcd": 2000, "ef": 2000, "▁x0": 667, "▁x1": 667, "▁x2": 666}


def test_words_are_cut_as_the_rule_says(spark):
    words = ["", "a", "abcd", "abcde", "<unk>", "äöüßé", "日本語の文字列", "x" * 131, "y" * 1000 + "ß", "abcdefgh"]
    want = [r["p"] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(word_pieces(F.col("w"), 4).alias("p")).collect()]
    assert piece_cutter(4)(pa.array(words)).to_pylist() == want
    assert piece_cutter(4)(pa.array([], pa.string())).to_pylist() == []


def test_operators_of_a_pass_equal_those_of_columns(spark):
    words, ids = [["abcde", "<unk>", "x"], [], ["abcdefghi"]], [[1, 2, 0], [], [2]]
    df = spark.createDataFrame([(i, w, x) for i, (w, x) in enumerate(zip(words, ids))], "k int, w array<string>, ids array<int>").orderBy("k")
    df = df.withColumn("al", align_labels(F.col("w"), F.col("ids"), 4)).withColumn("fl", feature_labels(F.col("al"), 6))
    names = {0: "O", 1: "A", 2: "B"}
    flipped = F.transform("fl", lambda g: F.when(g == -100, 0).otherwise((g + 1) % 3))
    gold, pred = decode_predictions(F.slice(flipped, 1, 4), F.col("fl"), F.create_map(*[F.lit(x) for kv in names.items() for x in kv]))
    rows = df.select("al", "fl", flipped.alias("p"), gold.alias("g"), pred.alias("q")).collect()
    al = align_labels(pa.array(words), pa.array(ids, pa.list_(pa.int32())), 4)
    fl = feature_labels(al, 6)
    assert al.to_pylist() == [r["al"] for r in rows] and fl.to_pylist() == [r["fl"] for r in rows]
    cut = pa.array([r["p"][:4] for r in rows], pa.list_(pa.int32()))
    g, q = decode_predictions(cut, fl, names)
    assert g.to_pylist() == [r["g"] for r in rows] and q.to_pylist() == [r["q"] for r in rows]
    assert argmax(pa.array([[0.1, 1.0, 1.0], [2.0, 0.0, 2.0]])).to_pylist() == [1, 0]
    drawn = [r[0] for r in spark.range(50).orderBy("id").select(uniform(F.lit(7), F.col("id"), F.lit("p"))).collect()]
    assert uniforms([f"7:{i}:p".encode() for i in range(50)]).tolist() == drawn


def test_realign_moves_strings_and_keeps_every_token(spark):
    odd = ["a\nb", "\\", "\\n", "\\N", "", "\0\\", "x\\\\N", None]
    packed = spark.createDataFrame([(1, 1, ["z"]), (1, 0, odd), (2, 0, []), (3, 0, ["t"])], "s int, frag int, token array<string>")
    preds = spark.createDataFrame([(1, 0, ["A", None, "\\N"]), (1, 1, ["B", "C"]), (4, 0, ["D"])], "s int, frag int, preds array<string>")
    got = {r["s"]: (r["tokens"], r["preds"]) for r in realign(preds, packed, ["s"]).collect()}
    assert got == {1: ([*odd, "z"], ["A", None, "\\N", None, None, None, None, None, "B"]), 2: ([], []), 3: (["t"], [None])}
    text = written(packed, ["token"]).collect()
    assert all(isinstance(r["token"], str) for r in text)
    ends, values = spelled(pa.array(["", "\n", None, "a\nb\n"]))
    assert ends.tolist() == [0, 0, 1, 1, 3] and values.to_pylist() == ["", "a", "b"]
    assert lists(np.array([0, 1]), pa.array(["x"])).to_pylist() == [["x"]]
