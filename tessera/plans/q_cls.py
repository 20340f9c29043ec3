"""Classification and topic-table queries.

Sentence classification: the first 10 dimensions of each stored vector
are the logits over 10 classes, ``label`` is the gold class, batches are
32 consecutive ids. Topic tables are derived from ``documents`` as the TSV
files the topic tasks read (see :func:`topic_lines6` / :func:`topic_lines7`).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions.arrays import argmax, sql_argmax
from tessera.operators.cls_metrics import (TOPICS_6, TOPICS_7, accuracy, batch_macro_f1, batch_mean_loss,
                                           macro_f1, map_labels, parse_topics_header, parse_topics_headerless,
                                           topic_map)
from tessera.operators.encode import as_text, topic_encode
from tessera.operators.vocab import BOS_ID, EOS_ID, PAD_ID, UNK_ID, build_vocab, encode_texts, sql_text_pieces, sql_vocab
from tessera.plans.q_encode import PIECE_LEN, VOCAB_SIZE
from tessera.plans.registry import register, table
from tessera.session import checkpoint_dir, stage_table
from tessera.sources.lines import discover_langs, file_value, list_files, write_line_files

N_CLASSES, CLS_BATCH = 64, 32    # every dimension is a class


def cls_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("gold"),
                    F.slice("embedding", 1, N_CLASSES).cast("array<double>").alias("logits"),
                    F.floor(F.col("vec_id") / CLS_BATCH).cast("long").alias("batch_id")) \
            .withColumn("pred", argmax("logits"))


SQL_CLS = f"""
cr AS (SELECT vec_id, label AS gold, CAST(embedding[1:{N_CLASSES}] AS DOUBLE[]) AS logits,
              CAST(vec_id // {CLS_BATCH} AS BIGINT) AS batch_id FROM embeddings),
cp AS (SELECT *, {sql_argmax('logits')} AS pred FROM cr)"""


def _sql_macro_f1(src, by):
    b = (", ".join(by) + ", ") if by else ""
    on = " AND ".join([f"g.{c} IS NOT DISTINCT FROM p.{c}" for c in by] + ["g.c = p.c"])
    tj = " AND ".join([f"t.{c} = u.{c}" for c in by] + ["t.c = u.c"])
    return f"""
cf AS (SELECT {b}gold AS g, pred AS p, count(*) AS n FROM {src} GROUP BY ALL),
gs AS (SELECT {b}g AS c, sum(n) AS n_gold FROM cf GROUP BY ALL),
ps AS (SELECT {b}p AS c, sum(n) AS n_pred FROM cf GROUP BY ALL),
tpc AS (SELECT {b}g AS c, n AS tp FROM cf WHERE g = p),
u AS (SELECT {", ".join(f"coalesce(g.{c}, p.{c}) AS {c}" for c in by) + ", " if by else ""}coalesce(g.c, p.c) AS c,
             coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred
      FROM gs g FULL OUTER JOIN ps p ON {on}),
pc AS (SELECT u.*, coalesce(t.tp, 0) AS tp FROM u LEFT JOIN tpc t ON {tj})"""


register("cls_argmax", f"WITH {SQL_CLS} SELECT vec_id, pred FROM cp")(
    lambda spark, sf: cls_rows(spark, sf).select("vec_id", "pred"))

register("cls_accuracy", f"""WITH {SQL_CLS}
SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM cp""")(
    lambda spark, sf: accuracy(cls_rows(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"), "n"))

register("cls_macro_f1", f"""WITH {SQL_CLS}, {_sql_macro_f1('cp', [])}
SELECT round(avg(CASE WHEN n_gold + n_pred > 0 THEN 2.0 * tp / (n_gold + n_pred) ELSE 0.0 END), 6) AS macro_f1,
       count(*) AS n_classes FROM pc""")(
    lambda spark, sf: macro_f1(cls_rows(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"), "n_classes"))

register("batch_mean_loss", f"""WITH {SQL_CLS},
bl AS (SELECT batch_id, avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
                           - logits[gold + 1]) AS batch_loss FROM cp GROUP BY batch_id)
SELECT round(avg(batch_loss), 6) AS mean_loss, count(*) AS n_batches FROM bl""")(
    lambda spark, sf: batch_mean_loss(cls_rows(spark, sf)).select(F.round("mean_loss", 6).alias("mean_loss"),
                                                                  "n_batches"))

register("batch_macro_f1", f"""WITH {SQL_CLS}, {_sql_macro_f1('cp', ['batch_id'])},
bf AS (SELECT batch_id, avg(CASE WHEN n_gold + n_pred > 0 THEN 2.0 * tp / (n_gold + n_pred) ELSE 0.0 END) AS f1
       FROM pc GROUP BY batch_id)
SELECT round(avg(f1), 6) AS mean_macro_f1, count(*) AS n_batches FROM bf""")(
    lambda spark, sf: batch_macro_f1(cls_rows(spark, sf)).select(F.round("mean_macro_f1", 6).alias("mean_macro_f1"),
                                                                 "n_batches"))


# ----- topic tables ----------------------------------------------------------
def _topic6(doc_id):
    names = F.array(*[F.lit(n) for n in TOPICS_6])
    return F.when(doc_id % 29 == 0, F.lit("Unknown")).otherwise(F.element_at(names, (doc_id % 6 + 1).cast("int")))


def topic_lines6(spark, sf):
    """Headerless TSV rows, one per line of a document: 2 fields when
    doc_id % 13 == 0, 4 fields when doc_id % 17 == 0, else ``id, label, line``."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("verse"))
    i, lab, verse = F.col("doc_id").cast("string"), _topic6(F.col("doc_id")), F.col("verse")
    line = (F.when(F.col("doc_id") % 13 == 0, F.concat_ws("\t", i, lab))
            .when(F.col("doc_id") % 17 == 0, F.concat_ws("\t", i, lab, verse, F.lit("extra")))
            .otherwise(F.concat_ws("\t", i, lab, verse)))
    return d.select(line.alias("text"))


_T6 = "[" + ", ".join(f"'{n}'" for n in TOPICS_6) + "]"
SQL_T6 = f"""
t6l AS (SELECT CASE WHEN doc_id % 13 = 0 THEN concat_ws(chr(9), CAST(doc_id AS VARCHAR), lab)
                   WHEN doc_id % 17 = 0 THEN concat_ws(chr(9), CAST(doc_id AS VARCHAR), lab, verse, 'extra')
                   ELSE concat_ws(chr(9), CAST(doc_id AS VARCHAR), lab, verse) END AS text
        FROM (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'Unknown' ELSE {_T6}[doc_id % 6 + 1] END AS lab,
                     unnest(string_split(text, chr(10))) AS verse FROM documents)),
t6p AS (SELECT string_split(text, chr(9)) AS p FROM t6l),
t6 AS (SELECT p[1] AS id, p[2] AS label, coalesce(p[3], 'nan') AS verse FROM t6p WHERE len(p) <= 3)"""

register("topic_scan6", f"WITH {SQL_T6} SELECT id, label, verse FROM t6")(
    lambda spark, sf: parse_topics_headerless(topic_lines6(spark, sf)))

_M6 = " UNION ALL ".join(f"SELECT '{n}' AS l, {i} AS label_id" for i, n in enumerate(TOPICS_6))
register("topic_label_map", f"""WITH {SQL_T6}, m AS ({_M6})
SELECT id, label, m.label_id, m.label_id IS NOT NULL AS mapped FROM t6 LEFT JOIN m ON t6.label = m.l""")(
    lambda spark, sf: map_labels(parse_topics_headerless(topic_lines6(spark, sf)), topic_map(spark, TOPICS_6))
    .select("id", "label", "label_id", "mapped"))


TOPIC_LENGTHS = (100, 160)


def q_topic_encode(spark, sf):
    """Verses encoded to both fixed lengths of the topic tasks, with the class id;
    the vocabulary is that of the verses."""
    t = parse_topics_headerless(topic_lines6(spark, sf)).select("id", "label", as_text(F.col("verse")).alias("verse"))
    t = stage_table(map_labels(t, topic_map(spark, TOPICS_6)).select("id", "label_id", "verse"), "topics")
    e = encode_texts(t, build_vocab(t, "verse", VOCAB_SIZE, PIECE_LEN), {"ids": "verse"}, PIECE_LEN)
    return e.select("id", "label_id", *[c for n in TOPIC_LENGTHS for c in topic_encode(F.col("ids"), n)])


def _sql_topic(n):
    full = f"list_concat([{BOS_ID}], ids[1:{n - 2}], [{EOS_ID}])"
    pad = lambda a, v: f"list_concat({a}, list_transform(range(greatest({n} - len({a}), 0)), lambda z: {v}))"
    ones = f"list_transform({full}, lambda x: 1)"
    return f"{pad(full, PAD_ID)} AS input_ids_{n}, {pad(ones, 0)} AS attention_mask_{n}"


register("topic_encode", f"""WITH {SQL_T6}, m AS ({_M6}),
{sql_vocab("t6", "verse", VOCAB_SIZE, PIECE_LEN).lstrip()},
tr AS MATERIALIZED (SELECT *, row_number() OVER () AS rn FROM t6),
tx AS (SELECT rn, unnest(range(len(pc))) AS pos, unnest(pc) AS piece FROM (SELECT rn, {sql_text_pieces('verse', PIECE_LEN)} AS pc FROM tr)),
ti AS (SELECT rn, list(coalesce(vocab.piece_id, {UNK_ID}) ORDER BY pos) AS ids FROM tx LEFT JOIN vocab ON vocab.piece = tx.piece GROUP BY rn),
te AS (SELECT tr.id, m.label_id, coalesce(ti.ids, []::INTEGER[]) AS ids FROM tr LEFT JOIN m ON tr.label = m.l LEFT JOIN ti ON ti.rn = tr.rn)
SELECT id, label_id, {", ".join(_sql_topic(n) for n in TOPIC_LENGTHS)} FROM te""")(q_topic_encode)


def topic_lines7(spark, sf):
    """One TSV file per source: a header ``index, category, text`` then one
    row per line of its documents."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("text"))
    names = F.array(*[F.lit(n) for n in TOPICS_7])
    cat = F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int"))
    rows = d.select("source", F.lit(False).alias("is_header"),
                    F.concat_ws("\t", F.col("doc_id").cast("string"), cat, F.col("text")).alias("text"))
    hdr = d.select("source").distinct().select("source", F.lit(True).alias("is_header"),
                                               F.lit("index\tcategory\ttext").alias("text"))
    return hdr.unionByName(rows)


_T7 = "[" + ", ".join(f"'{n}'" for n in TOPICS_7) + "]"
register("topic_scan7", f"""
SELECT source, {_T7}[doc_id % 7 + 1] AS category, unnest(string_split(text, chr(10))) AS text FROM documents""")(
    lambda spark, sf: parse_topics_header(topic_lines7(spark, sf), ["source"]))


def q_discover_langs(spark, sf):
    """Documents written as one text file per language and source; the languages
    come from the paths of the files that are there."""
    d = table(spark, sf, "documents").withColumn("file_name", F.concat(F.col("lang"), F.lit("_"), F.col("source")))
    path = os.path.join(checkpoint_dir(spark), "tables", f"topics-{uuid.uuid4().hex[:12]}")
    write_line_files(d, path, "file_name", ["doc_id"])
    files = list_files(spark, path, "*.txt")
    return discover_langs(files.withColumn("file_name", file_value("file_name")))


register("discover_langs", """
SELECT DISTINCT split_part(lang || '_' || source, '_', 1) AS lang FROM documents""")(q_discover_langs)
