import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.draws import uniform
from tessera.operators.batching import len_stats, row_numbers
from tessera.operators.encode import mlm_mask
from tessera.operators.subword import _Chunks, longest_match
from tessera.operators.vocab import piece_cutter


def test_two_sides_that_share_words_take_little_more_than_one():
    import random
    rnd = random.Random(1)
    text = pa.array([" ".join(f"w{rnd.randrange(20000)}" for _ in range(60)) for _ in range(500)])
    rows = pa.RecordBatch.from_arrays([pa.array(range(500)), text, text], ["k", "t", "u"])
    one, two = (_Chunks(["k"], [], cols, piece_cutter(4)).chunk(rows, 0)["rows"].nbytes for cols in ({"a": "t"}, {"a": "t", "b": "u"}))
    assert two < 1.4 * one


def test_a_word_is_not_a_row_for_each_of_its_substrings(spark):
    vocab = spark.createDataFrame([("<unk>", 3, True), ("▁ab", 5, False), ("c", 6, False), ("cd", 7, False)], "piece string, piece_id int, is_special boolean")
    words = spark.createDataFrame([("abcd",), ("xyab",), ("abxcdy",), ("<unk>",), ("abcd",)], "word string")
    out = longest_match(words, vocab)
    assert {r["word"]: r["ids"] for r in out.collect()} == {"abcd": [5, 7], "xyab": [3], "abxcdy": [5, 3, 7, 3], "<unk>": [3]}
    assert any("match-chunks" in f for f in out.inputFiles())


def test_numbered_rows_are_staged_in_columns(spark):
    df = spark.createDataFrame([(i, [1] * (i % 5)) for i in range(100)], "k int, a array<int>").repartition(7)
    out = row_numbers(df, [F.col("k").desc()])
    assert sorted((r["k"], r["row_no"]) for r in out.collect()) == [(i, 99 - i) for i in range(100)]
    assert any("sorted-" in f for f in out.inputFiles())


def test_len_stats_of_numbers(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, []), (1, [3] * 9)], "b long, a array<int>")
    want = sorted(map(tuple, len_stats(df, "b", "a", 10).collect()))
    assert sorted(map(tuple, len_stats(df.select("b", F.size("a").alias("n")), "b", "n", 10).collect())) == want == [(0, 2, 4, 2), (1, 9, 10, 1)]


def test_masks_of_long_rows_follow_the_draws(spark):
    n = 1500
    df = spark.createDataFrame([(1, [9] * n, [1] + [0] * (n - 2) + [1]), (2, [], []), (3, None, None)], "k int, ids array<int>, sp array<int>")
    inp, lab = mlm_mask(F.col("ids"), F.col("sp"), [F.col("k")], 7, 100, 0.3)
    got = {r["k"]: (r["i"], r["l"]) for r in df.select("k", inp.alias("i"), lab.alias("l")).collect()}
    drawn = [r[0] for r in spark.range(n).orderBy("id").select(uniform(F.lit(7), F.lit(1), F.col("id"), F.lit("p"))).collect()]
    assert [x != -100 for x in got[1][1]] == [0 < i < n - 1 and d < 0.3 for i, d in enumerate(drawn)]
    assert got[2] == ([], []) and got[3] == (None, None)
