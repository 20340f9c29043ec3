from pyspark.sql import functions as F

from tessera.functions.romanize import romanize
from tessera.functions.text import py_strip, split_lines, split_ws


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_py_strip_matches_python(spark):
    for s in ["  a b  ", "　x　", "\x1cx\x1f", "plain", "", "\t\n", "a "]:
        assert one(spark, py_strip("t"), s) == s.strip()


def test_split_lines_matches_splitlines(spark):
    s = "a\nb\r\nc\x0bd\x0ce\x1cf g\u0085h\n"
    assert one(spark, split_lines("t"), s) == s.splitlines()
    assert one(spark, split_lines("t"), "") == []
    assert one(spark, split_lines("t", unicode_breaks=False), "a\x0bb\nc") == ["a\x0bb", "c"]


def test_split_ws_matches_python_split(spark):
    for s in ["  a  b\tc\n", "", "   ", "x　y", "one"]:
        assert one(spark, split_ws("t"), s) == s.split()


def test_romanize_rules(spark):
    cases = [
        ("café ñandú", None, "cafe nandu"),
        ("Straße", None, "Strasse"),
        ("Über", "de", "Ueber"),
        ("Über", "fr", "Uber"),
        ("Москва", None, "Moskva"),
        ("щи", None, "shchi"),
        ("αθήνα", None, "athina"),
        ("ουρανός", None, "ouranos"),
        ("한국", None, "hanguk"),
        ("かな", None, "kana"),
        ("漢字", None, "漢字"),
        ("  plain ascii  ", None, "plain ascii"),
    ]
    df = spark.createDataFrame([(t, l) for t, l, _ in cases], "t string, l string")
    got = [r["r"] for r in df.select(romanize(F.col("t"), F.col("l")).alias("r")).collect()]
    assert got == [e for _, _, e in cases]


def test_romanize_idempotent_on_ascii(spark):
    s = "The quick brown fox, 42!"
    assert one(spark, romanize(F.col("t")), s) == s
