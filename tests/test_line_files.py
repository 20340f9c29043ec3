import os
import random
import tempfile

from pyspark.sql import functions as F

from tessera.operators.tagging import read_tokenized
from tessera.sources.lines import discover_langs, list_files, read_lines, read_parallel, write_line_files


def test_unicode_breaks_across_blocks_equal_splitlines(spark):
    rnd = random.Random(1)
    d = tempfile.mkdtemp()
    texts = {}
    for name in ("a.txt", "b.txt"):
        parts = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 30))) + rnd.choice(["\n", "\r\n", "\x0b", "\x85", " ", "\x1c"]) for _ in range(3000)]
        texts[name] = "".join(parts) + "end\n"
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(texts[name])
    rows = read_lines(spark, d, unicode_breaks=True, with_block=True, block_bytes=3000).collect()
    assert len({(r["file"], r["block"]) for r in rows}) > 20
    for name, text in texts.items():
        mine = sorted((r["line_no"], r["text"]) for r in rows if r["file"].endswith(name))
        assert mine == list(enumerate(text.splitlines()))


def test_written_files_come_back_in_order(spark):
    df = spark.createDataFrame([(i % 3, i, None if i == 4 else f" line {i} ") for i in range(600)], "f int, k int, text string")
    path = os.path.join(tempfile.mkdtemp(), "x")
    write_line_files(df.repartition(5), path, "f", ["k"])
    rows = read_parallel(spark, path, 500).withColumn("f", F.regexp_extract("file", "f=(\\d+)", 1).cast("int")).collect()
    assert len({r["file"] for r in rows}) == 3 and len(rows) == 600
    for r in rows:
        k = 3 * r["idx"] + r["f"]
        assert r["text"] == ("" if k == 4 else f"line {k}")


def test_sentences_are_carried_across_blocks(spark):
    rnd = random.Random(7)
    d = tempfile.mkdtemp()
    lines = [rnd.choice(["", "", "-DOCSTART- -X- O"]) if rnd.random() < 0.2 else f"w{i}\tB-X" if rnd.random() < 0.8 else f"w{i}" for i in range(4000)]
    lines += [f"long{i}\tO" for i in range(2000)]          # a sentence over many blocks
    with open(os.path.join(d, "t.tsv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    want, words = [], []
    for line in lines + [""]:
        if line == "" or line.startswith("-DOCSTART-"):
            if words:
                want.append(words)
            words = []
        else:
            words.append(line.split("\t")[0])
    for size in (400, 10_000_000):
        read = read_tokenized(read_lines(spark, d, with_block=True, block_bytes=size), "en", ["file"])
        got = {r["guid"]: r["words"] for r in read.collect()}
        assert got == {f"en-{i + 1}": w for i, w in enumerate(want)}


def test_empty_folder_of_lines(spark):
    d = tempfile.mkdtemp()
    open(os.path.join(d, "e.txt"), "w").close()
    assert read_lines(spark, d).count() == 0 and read_lines(spark, d, unicode_breaks=True).count() == 0


def test_discovery_lists_files_and_names_each_language_once(spark):
    d = tempfile.mkdtemp()
    os.mkdir(os.path.join(d, "deep"))
    names = ["en_a.tsv", "en_b.tsv", "deu_Latn_a.tsv", "deep/fr_x.tsv", "en_notes.md"]
    for i, name in enumerate(names):
        with open(os.path.join(d, name), "w") as f:
            f.write("x" * (i + 1))
    files = list_files(spark, d, "*.tsv")
    assert {(r["file_name"], r["length"]) for r in files.collect()} == {(os.path.basename(n), i + 1) for i, n in enumerate(names[:4])}
    assert sorted(r["lang"] for r in discover_langs(files).collect()) == ["deu", "en", "fr"]
    assert "content" not in files._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_small_blocks_share_tasks(spark):
    d = tempfile.mkdtemp()
    want = set()
    for i in range(40):
        with open(os.path.join(d, f"{i}.txt"), "w") as f:
            f.write("".join(f"{i} {k}\n" for k in range(500)))
        want |= {(f"{i}.txt", k, f"{i} {k}") for k in range(500)}
    parts = spark.conf.get("spark.sql.files.maxPartitionNum", None)
    lines = read_lines(spark, d, with_block=True, block_bytes=500)
    staged = [f for f in lines.inputFiles() if "lines-" in f]
    blocks = lines.select("file", "block").distinct().count()
    assert {(os.path.basename(r["file"]), r["line_no"], r["text"]) for r in lines.collect()} == want
    assert blocks > 200 and len(staged) <= 17 * spark.sparkContext.defaultParallelism < blocks
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) == parts
