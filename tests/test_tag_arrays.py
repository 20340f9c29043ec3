from pyspark.sql import functions as F

from tessera.operators.fragments import pack_fragments
from tessera.operators.tag_arrays import drop_lines, token_rows
from tessera.operators.tag_metrics import spans
from tessera.operators.tagging import assemble_sentences, label_vocab, read_tagged, realign, sentence_ids, unk_tokens
from tessera.operators.vocab import encode_word_arrays

LINES = ["", "Paris B-LOC", " is\tO ", "", "", "　nice X", "a b c", "abcdefghijklmnopq I-LOC", "", "z S-ORG", "E-PER E-PER"]


def _files(spark):
    return spark.createDataFrame([("f", LINES), ("g", LINES[1:4]), ("h", []), ("i", [""])], "file string, text array<string>")


def _tokens(df):
    return drop_lines(sentence_ids(read_tagged(df), ["file"]).drop("n_fields"), "is_blank", ["sent_no", "token", "label"], "line_no")


def _rows(spark):
    rows = _files(spark).select("file", F.posexplode("text").alias("line_no", "text"))
    return sentence_ids(read_tagged(rows), ["file"]).filter(~F.col("is_blank"))


def _sorted(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_arrays_and_rows_give_the_same_fragments(spark):
    cols = ["file", "line_no", "sent_no", "frag", "pos", "token", "label", "n_pieces"]
    got, want = (pack_fragments(unk_tokens(t, 6, 4, 3), ["file", "sent_no"], 3, carry=["token", "label"]) for t in (_tokens(_files(spark)), _rows(spark)))
    assert _sorted(token_rows(got, cols[1:]), *cols) == _sorted(want, *cols)


def test_a_file_per_row_needs_no_shuffle(spark):
    t = unk_tokens(_tokens(_files(spark)), 6, 4, 3, original="original")
    packed = pack_fragments(t, ["file", "sent_no"], 3, carry=["token", "label", "original"])
    s = assemble_sentences(packed, ["file", "sent_no", "frag"], "line_no", {"words": "token", "o": "original"}, number="n")
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
    got = {(r["sent_no"], r["frag"]): (r["words"], r["o"], r["n"]) for r in s.filter("file = 'f'").collect()}
    assert got[(1, 0)] == (["Paris", "is"], [None, None], 1) and got[(3, 0)][0][-1] == "<unk>" and got[(3, 0)][1][-1] == "abcdefghijklmnopq"
    assert sorted(n for _, _, n in got.values()) == list(range(1, len(got) + 1))


def test_spans_of_arrays_and_rows(spark):
    s = assemble_sentences(_tokens(_files(spark)), ["file", "sent_no"], "line_no", {"label": "label", "line_no": "line_no"})
    cols = ["file", "sent_no", "span_type", "start", "end"]
    assert _sorted(spans(s, ["file", "sent_no"], pos_col="line_no"), *cols) == _sorted(spans(_rows(spark), ["file", "sent_no"], pos_col="line_no"), *cols)


def test_realign_takes_arrays(spark):
    packed = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"]), (2, 0, ["d"])], "s int, frag int, token array<string>")
    preds = spark.createDataFrame([(1, 0, ["A"]), (1, 1, ["C", "X"]), (3, 0, ["Y"])], "s int, frag int, preds array<string>")
    got = {r["s"]: (r["tokens"], r["preds"]) for r in realign(preds, packed, ["s"]).collect()}
    assert got == {1: (["a", "b", "c"], ["A", None, "C"]), 2: (["d"], [None])}


def test_label_vocab_of_arrays(spark):
    df = spark.createDataFrame([(["O", "B"],), (["B", "A"],)], "label array<string>")
    assert {r["label"] for r in label_vocab(df).collect()} == {"O", "A", "B"}


def test_kept_word_arrays_are_not_moved(spark):
    vocab = spark.createDataFrame([("<unk>", 3, True), ("▁ab", 5, False)], "piece string, piece_id int, is_special boolean")
    df = spark.createDataFrame([(1, ["ab", "cd", "ab"]), (2, []), (3, None)], "k int, w array<string>")
    out = encode_word_arrays(df, vocab, {"ids": "w"}, 4)
    assert out.columns == ["k", "w", "ids"]
    assert _sorted(out, "k", "w", "ids") == [(1, ["ab", "cd", "ab"], [5, 3, 5]), (2, [], []), (3, None, None)]
    staged = [f for f in out.inputFiles() if "word-chunks" in f]
    assert staged and "w" not in spark.read.parquet(*staged).columns
