from pyspark.sql import functions as F

from tessera.functions.draws import uniform
from tessera.operators.encode import mlm_mask
from tessera.operators.vocab import cut_words, word_pieces
from tessera.plans.q_encode import encoded, valid
from tessera.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_masking_draws_once_and_as_before(spark):
    rows = [(k, [0, *range(10, 60), 2], [1] + [0] * 50 + [1]) for k in range(40)] + [(99, None, None), (None, [7], [0])]
    df = spark.createDataFrame(rows, "k long, ids array<int>, sp array<int>")
    inp, lab = mlm_mask(F.col("ids"), F.col("sp"), [F.col("k")], 7, 100, 0.5)
    out = df.select("k", "ids", "sp", inp.alias("inp"), lab.alias("lab"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1

    def draws(t):
        return F.transform("ids", lambda x, i: uniform(F.lit(7), F.col("k"), i, F.lit(t))).alias(t)
    u = {t: draws(t) for t in ("p", "r", "h", "id")}
    for r in out.select("*", *u.values()).collect():
        if r["ids"] is None:
            assert r["inp"] is None and r["lab"] is None
            continue
        for i, x in enumerate(r["ids"]):
            hit = r["sp"][i] == 0 and r["p"][i] < 0.5
            to = x if not hit else 4 if r["r"][i] < 0.8 else int(r["id"][i] * 100) if r["h"][i] < 0.5 else x
            assert (r["inp"][i], r["lab"][i]) == (to, x if hit else -100)


def test_cut_words_are_word_pieces(spark):
    df = spark.createDataFrame([("",), ("a",), ("abcd",), ("abcde𝒳z",), ("<unk>",)], "word string")
    for r in cut_words(df, 4).select("pieces", word_pieces(F.col("word"), 4).alias("want")).collect():
        assert r["pieces"] == r["want"]


def test_cut_tables_are_columnar(spark):
    checkpoint_dir(spark)
    for df, name in ((valid(spark, SF, cut=True), "valid-pairs"), (encoded(spark, SF, cut=True), "encoded-pairs")):
        assert df.inputFiles() and all(name in f and f.endswith(".parquet") for f in df.inputFiles())
