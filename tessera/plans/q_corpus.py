"""Corpus → transliteration pair queries over ``documents``.

Derivation: each document is a corpus file; its text split at every
Unicode line boundary (``str.splitlines``) gives the ordered lines.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.romanize import romanize, sql_romanize
from tessera.functions.text import py_strip, split_lines, sql_py_strip, sql_split_lines
from tessera.functions.draws import sql_key, sql_uniform
from tessera.operators.pairs import (assign_split, doc_pairs, pair_by_line, pair_counts,
                                     pair_line_counts, split_counts, valid_pairs)
from tessera.plans.registry import register, table
from tessera.session import checkpoint_dir
from tessera.sources.lines import file_value, lines_of, read_lines, read_parallel, write_line_files
from tessera.sources.pairs import read_pairs, write_pairs

SPLIT_SEED = 7
SAMPLE_CAP = 1000


def doc_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return lines_of(d, "text", ["doc_id", "lang", "source"], unicode_breaks=True)


def pairs(spark, sf_dir):
    """Pair table. Romanization runs once per document, before the line
    split: the rules never match across a line break, so this equals
    line-by-line romanization, evaluates the rule expression once per
    document, and leaves the validity filter (above the generator) unable
    to re-evaluate it."""
    d = table(spark, sf_dir, "documents")
    return doc_pairs(d, "text", "lang", ["doc_id", "lang", "source"])


SQL_LINES = f"""
dl AS (SELECT doc_id, lang, source, CAST(unnest(range(len(arr))) AS BIGINT) AS line_no,
              unnest(arr) AS text
       FROM (SELECT doc_id, lang, source, {sql_split_lines('text')} AS arr FROM documents))"""
SQL_PAIRS = SQL_LINES + f""",
pr AS (SELECT doc_id, lang, source, line_no, text, {sql_romanize('text', 'lang')} AS transliteration FROM dl)"""
SQL_VALID = SQL_PAIRS + """,
vp AS (SELECT * FROM pr WHERE text IS NOT NULL AND length(text) > 0
                          AND transliteration IS NOT NULL AND length(transliteration) > 0)"""


register("doc_lines", f"""WITH {SQL_LINES}
SELECT source, doc_id, line_no, text FROM dl""")(
    lambda spark, sf: doc_lines(spark, sf).select("source", "doc_id", "line_no", "text"))

# Text files made from the tables hold 100 documents each and are read in
# blocks of 64 KiB, so that a file has several blocks at every scale.
FILE_DOCS, FILE_BLOCK = 100, 64 << 10


def _file_no():
    return F.floor(F.col("doc_id") / FILE_DOCS).cast("long")


def _files(spark):
    return os.path.join(checkpoint_dir(spark), "tables", f"lines-{uuid.uuid4().hex[:12]}")


def q_lines_scan(spark, sf_dir):
    """Documents written to text files, one after another, and read again as lines."""
    path = _files(spark)
    write_line_files(table(spark, sf_dir, "documents").withColumn("file_no", _file_no()), path, "file_no", ["doc_id"])
    lines = read_lines(spark, path, unicode_breaks=True, block_bytes=FILE_BLOCK)
    return lines.select(file_value("file_no").cast("long").alias("file_no"), "line_no", "text")


register("lines_scan", f"""WITH d AS (
  SELECT doc_id, doc_id // {FILE_DOCS} AS file_no, {sql_split_lines("(coalesce(text, '') || chr(10))")} AS arr FROM documents),
o AS (SELECT *, CAST(sum(len(arr)) OVER (PARTITION BY file_no ORDER BY doc_id) - len(arr) AS BIGINT) AS before FROM d)
SELECT file_no, before + CAST(unnest(range(len(arr))) AS BIGINT) AS line_no, unnest(arr) AS text FROM o""")(q_lines_scan)


def q_parallel_scan(spark, sf_dir):
    """Valid pairs written as two parallel sets of files and paired again by
    file and line."""
    v = valid_pairs(pairs(spark, sf_dir)).withColumn("file_no", _file_no())
    sides = []
    for c in ("text", "transliteration"):
        path = _files(spark)
        write_line_files(v, path, "file_no", ["doc_id", "line_no"], c)
        sides.append(read_parallel(spark, path, FILE_BLOCK).select(file_value("file_no").cast("long").alias("file_no"), "idx", F.col("text").alias(c)))
    return sides[0].join(sides[1], ["file_no", "idx"], "full_outer")


register("parallel_scan", f"""WITH {SQL_VALID}
SELECT doc_id // {FILE_DOCS} AS file_no, row_number() OVER (PARTITION BY doc_id // {FILE_DOCS} ORDER BY doc_id, line_no) - 1 AS idx,
       {sql_py_strip('text')} AS text, {sql_py_strip('transliteration')} AS transliteration FROM vp""")(q_parallel_scan)

register("romanize", f"""WITH {SQL_PAIRS}
SELECT doc_id, line_no, lang, transliteration FROM pr""")(
    lambda spark, sf: pairs(spark, sf).select("doc_id", "line_no", "lang", "transliteration"))

register("pair_filter", f"""WITH {SQL_VALID}
SELECT doc_id, line_no, text, transliteration FROM vp""")(
    lambda spark, sf: valid_pairs(pairs(spark, sf)).select("doc_id", "line_no", "text", "transliteration"))


def q_pair_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    texts = doc_lines(spark, sf_dir)
    # the "external" transliteration file: the romanized document, split into
    # lines and stripped line by line
    tr = d.select("doc_id", F.posexplode(split_lines(romanize(F.col("text"), F.col("lang"), strip=False)))
                  .alias("line_no", "t"))
    tr = tr.select("doc_id", F.col("line_no").cast("long").alias("line_no"), py_strip("t").alias("transliteration"))
    paired = pair_by_line(texts, tr, ["doc_id", "line_no"])
    return pair_line_counts(paired, ["doc_id"])


register("pair_join", f"""WITH {SQL_LINES},
rt AS (SELECT doc_id, {sql_split_lines('rtext')} AS arr FROM
        (SELECT doc_id, {sql_romanize('text', 'lang', strip=False)} AS rtext
         FROM documents)),
tr AS (SELECT doc_id, CAST(unnest(range(len(arr))) AS BIGINT) AS line_no, unnest(arr) AS t FROM rt),
tr2 AS (SELECT doc_id, line_no, {sql_py_strip('t')} AS transliteration FROM tr),
j AS (SELECT coalesce(dl.doc_id, tr2.doc_id) AS doc_id, dl.text, tr2.transliteration
      FROM dl FULL OUTER JOIN tr2 ON dl.doc_id = tr2.doc_id AND dl.line_no = tr2.line_no)
SELECT doc_id, count(text) AS n_text, count(transliteration) AS n_transliteration,
       count(CASE WHEN text IS NOT NULL AND transliteration IS NOT NULL THEN 1 END) AS n_paired,
       count(text) = count(transliteration) AS counts_equal
FROM j GROUP BY doc_id""")(q_pair_join)

register("pair_counts", f"""WITH {SQL_PAIRS}
SELECT source, lang, count(text) AS n_text,
       count(CASE WHEN length(transliteration) > 0 THEN 1 END) AS n_transliteration,
       count(CASE WHEN length(text) > 0 AND length(transliteration) > 0 THEN 1 END) AS n_valid
FROM pr GROUP BY source, lang""")(
    lambda spark, sf: pair_counts(pairs(spark, sf), ["source", "lang"]))


def q_split_counts(spark, sf_dir):
    v = assign_split(valid_pairs(pairs(spark, sf_dir)), ["doc_id"], seed=SPLIT_SEED)
    return split_counts(v, ["lang", "split"], cap=SAMPLE_CAP)


_U = sql_uniform(sql_key(str(SPLIT_SEED), "doc_id"))
register("split_counts", f"""WITH {SQL_VALID},
s AS (SELECT lang, CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.8 + 0.1 THEN 'dev' ELSE 'test' END AS split
      FROM vp)
SELECT lang, split, count(*) AS n_examples, least(CAST({SAMPLE_CAP} AS BIGINT), count(*)) AS n_samples
FROM s GROUP BY lang, split""")(q_split_counts)


def _roundtrip(spark, sf_dir, ext):
    v = valid_pairs(pairs(spark, sf_dir)).select("text", "transliteration")
    path = os.path.join(checkpoint_dir(spark), "tables", f"pairs-{uuid.uuid4().hex[:12]}.{ext}")
    write_pairs(v, path)
    return read_pairs(spark, path)


register("pairs_scan", f"""WITH {SQL_VALID}
SELECT text, transliteration FROM vp""")(lambda spark, sf: _roundtrip(spark, sf, "csv"))

register("pairs_roundtrip", f"""WITH {SQL_VALID}
SELECT text, transliteration FROM vp""")(lambda spark, sf: _roundtrip(spark, sf, "json"))
