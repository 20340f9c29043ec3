import random

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.subword import encode_by_words, longest_match, tokenize
from tessera.operators.vocab import UNK_ID, build_vocab, tokenize_with

VOCAB = [("<s>", 0, True), ("<unk>", 3, True), ("▁un", 5, False), ("▁", 6, False), ("re", 7, False), ("read", 8, False),
         ("able", 9, False), ("a", 10, False), ("▁unre", 11, False), ("e", 12, False), ("d", 13, False)]


def vocab(spark):
    return spark.createDataFrame(VOCAB, "piece string, piece_id int, is_special boolean")


def plain(word, pieces, unk=UNK_ID):
    """Longest piece at every position, by trying all lengths."""
    if word == "<unk>":
        return [unk]
    text, at, ids = "▁" + word, 0, []
    while at < len(text):
        for end in range(len(text), at, -1):
            if text[at:end] in pieces:
                ids.append(pieces[text[at:end]])
                at = end
                break
        else:
            if not ids or ids[-1] != unk:
                ids.append(unk)
            at += 1
    return ids


def test_longest_match_equals_plain_search(spark):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("readblun<s>é") for _ in range(rnd.randint(1, 12))) for _ in range(300)}
    words |= {"unreadable", "unread", "<unk>", "<s>", "é", "aéa", "x" * 5000, "read" * 2000}
    df = spark.createDataFrame([(w,) for w in words] + [("unread",)], "word string")
    pieces = {p: i for p, i, special in VOCAB if not special}
    got = {r["word"]: r["ids"] for r in longest_match(df, vocab(spark)).collect()}
    assert got == {w: plain(w, pieces) for w in words}
    assert got["unreadable"] == [11, 10, 13, 9] and got["é"] == [6, UNK_ID]


def test_word_without_any_piece_is_one_unknown(spark):
    only = spark.createDataFrame([("zz", 5, False)], "piece string, piece_id int, is_special boolean")
    df = spark.createDataFrame([("abc",), ("zz",)], "word string")
    assert {r["word"]: r["ids"] for r in longest_match(df, only).collect()} == {"abc": [UNK_ID], "zz": [UNK_ID, 5]}


def test_tokenize_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "x", None), (2, "", "y", "read"), (3, " \t ", None, "un read"), (4, "unread  able\nread", "z", "é <unk>")] * 3
    df = spark.createDataFrame(rows, "chunk int, text string, words string, other string")
    out = tokenize(df, vocab(spark), {"a": "text", "b": "other"})
    assert out.columns == ["chunk", "words", "a", "b"]
    pieces = {p: i for p, i, special in VOCAB if not special}

    def ids(t):
        return None if t is None else [i for w in t.split() for i in plain(w, pieces)]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str((c, w, ids(t), ids(o))) for c, t, w, o in rows)
    assert tokenize(df.limit(0), vocab(spark), {"a": "text"}).count() == 0


def test_many_chunks_give_the_same_ids(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["read", "able", "une", "q"]) for _ in range(rnd.randint(0, 9)))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(7)
    table = spark.createDataFrame([("read", [1, 2]), ("able", [3]), ("une", [])], "word string, ids array<int>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r["k"]: r["ids"] for r in encode_by_words(df, lambda words: words.join(table, "word"), {"ids": "text"}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    known = {"read": [1, 2], "able": [3], "une": [], "q": [UNK_ID]}
    assert got == {k: [i for w in t.split() for i in known[w]] for k, t in rows}


def test_tokenizer_hook_feeds_the_vocabulary(spark):
    """A caller's own tokenizer runs in Arrow batches; its pieces make a vocabulary."""
    df = spark.createDataFrame([(1, "ab-cd ab"), (2, None)], "k int, text string")
    cut = tokenize_with(lambda texts: pd.Series([[] if t is None else t.replace("-", " - ").split() for t in texts]))
    got = {r["k"]: r["pieces"] for r in df.select("k", cut(F.col("text")).alias("pieces")).collect()}
    assert got == {1: ["ab", "-", "cd", "ab"], 2: []}
    words = df.select(F.explode(cut(F.col("text"))).alias("w"))
    assert build_vocab(words, "w", 10, 4, pre_split=True).filter("piece = '▁ab'").first()["piece_id"] == 5
