import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators.pairs import doc_pairs, make_pairs, pair_by_line, valid_pairs
from tessera.sources.lines import lines_of, read_lines
from tessera.sources.pairs import read_pairs, write_pairs


def test_read_lines_numbers_across_files(spark):
    d = tempfile.mkdtemp()
    for name, n in (("a.txt", 3000), ("b.txt", 20)):
        with open(os.path.join(d, name), "w") as f:
            f.write("".join(f"{name}-{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    assert len(rows) == 3020
    for r in rows:
        assert r["text"] == f"{os.path.basename(r['file'])}-{r['line_no']}"


def test_read_lines_unicode_breaks(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "u.txt"), "w", encoding="utf-8") as f:
        f.write("a\x0bb\nc\n d\n")
    rows = sorted((r["line_no"], r["text"]) for r in read_lines(spark, d, unicode_breaks=True).collect())
    assert rows == [(0, "a"), (1, "b"), (2, "c"), (3, ""), (4, "d")]


def test_valid_pairs_edges(spark):
    df = spark.createDataFrame([("a", "a"), ("", "x"), ("x", ""), (None, "x"), (" ", " "), ("NA", "NA")],
                               "text string, transliteration string")
    got = sorted(r["text"] for r in valid_pairs(df).collect())
    assert got == [" ", "NA", "a"]


def test_doc_pairs_equal_line_pairs(spark):
    docs = spark.createDataFrame([(1, "Ça va\n  Grüße \nplain", "de"), (2, "", "fr")], "id long, text string, lang string")
    a = doc_pairs(docs, "text", "lang", ["id"]).select("id", "line_no", "text", "transliteration")
    b = make_pairs(lines_of(docs, "text", ["id", "lang"])).select("id", "line_no", "text", "transliteration")
    assert sorted(a.collect()) == sorted(b.collect())
    assert [r["transliteration"] for r in a.orderBy("line_no").collect()] == ["Ca va", "Gruesse", "plain"]


def test_csv_roundtrip_keeps_awkward_text(spark):
    rows = [('say "hi", ok', "x"), ("back\\slash", "y"), ("two\nlines", "z"), ("NA", "null")]
    df = spark.createDataFrame(rows, "text string, transliteration string")
    p = os.path.join(tempfile.mkdtemp(), "pairs.csv")
    write_pairs(df, p)
    assert sorted(tuple(r) for r in read_pairs(spark, p).collect()) == sorted(rows)


def test_pair_by_line_reports_missing(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line_no long, text string")
    b = spark.createDataFrame([(0, "X")], "line_no long, transliteration string")
    got = {r["line_no"]: r["status"] for r in pair_by_line(a, b, ["line_no"]).collect()}
    assert got == {0: "paired", 1: "missing_transliteration"}
