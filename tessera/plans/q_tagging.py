"""Sequence-tagging queries over ``documents``.

Derivation of the raw tag file (one per document): every word of every line
becomes a token line ``word<TAB>label``, and every document line ends with
a blank line. The gold label comes from the word's shape: ASCII capital first →
``B-CAP``, ending in ``.``/``,`` → ``I-CAP`` (so ``I`` after ``O`` occurs),
otherwise ``O``. Words whose length is a multiple of 7 get no label field,
multiples of 11 a third field — both fall back to the default label. A line
with more than ``LONG`` characters besides spaces also gives one token of all
its words joined, which no sequence can hold (the unknown token's case).
Predictions flip the gold label to the next label with probability 0.2
(md5 draw per token).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import argmax
from tessera.functions.draws import sql_key, sql_uniform, uniforms
from tessera.functions.text import SPLITLINES_RE, sql_split_lines, sql_split_ws
from tessera.operators.batching import row_numbers
from tessera.operators.pairs import assign_split
from tessera.operators.tag_metrics import STRICT, array_spans, prf, span_counts, spans
from tessera.operators.fragments import pack_fragments
from tessera.operators.tag_arrays import INTS, STRING, STRINGS, changed, drop_lines, flat, lists, only, passed, rebuilt, token_rows
from tessera.operators.tagging import (IGNORE, align_labels, assemble_sentences, decode_predictions,
                                       feature_labels,
                                       few_shot, guid, id_map, id_names, label_map, label_vocab, lang_ids,
                                       read_tagged, read_tokenized, realign, sentence_ids, tag_features,
                                       unk_tokens)
from tessera.operators.vocab import (BOS_ID, EOS_ID, PAD_ID, UNK, UNK_ID, build_vocab, encode_word_arrays,
                                     sql_piece_count, sql_vocab, sql_word_pieces)
from tessera.plans.registry import register, table
from tessera.session import checkpoint_dir, stage_table
from tessera.sources.lines import file_value, read_lines, write_line_files
from tessera.sources.stores import cached_features

TAG_MAX_LEN, PIECE_LEN, SPECIAL = 256, 4, 3
BUDGET = TAG_MAX_LEN - SPECIAL
LONG = BUDGET * PIECE_LEN
VOCAB_SIZE = 2000
FLIP_P, PRED_SEED, SPLIT_SEED, FEW_SHOT_N = 0.2, 17, 19, 50
LANG2ID = [("de", 0), ("en", 1), ("es", 2)]
REPORT_LANGS = ["de", "en", "es", "fr", "xx"]


LABELS = ["B-CAP", "I-CAP", "O"]


def _tag_lines(text: pa.Array) -> pa.Array:
    """Tag lines of documents. Words of a line are what spaces part (the corpus
    has no other whitespace inside lines); long lines also give their words
    joined; an empty line ends each."""
    text = pc.fill_null(text, "")
    offsets, line = flat(pc.split_pattern_regex(text, SPLITLINES_RE))
    ends = offsets[1:]
    last_empty = np.zeros(len(line), bool)
    last_empty[ends - 1] = pc.equal(line.take(pa.array(ends - 1)), "").to_numpy(zero_copy_only=False)
    line = line.filter(pa.array(~last_empty))
    offsets = offsets - np.concatenate([[0], np.cumsum(last_empty)])[offsets]
    at, word = flat(pc.split_pattern(line, " "))
    some = pc.not_equal(word, "")
    of_line = np.repeat(np.arange(len(line)), np.diff(at))[some.to_numpy(zero_copy_only=False)]
    word = word.filter(some)
    joined = pc.replace_substring(line, " ", "")
    long = np.flatnonzero(pc.utf8_length(joined).to_numpy(zero_copy_only=False) > LONG)
    word, of_line = pa.concat_arrays([word, joined.take(pa.array(long))]), np.concatenate([of_line, long])
    # the label by the first and the last byte: what it looks at is ASCII
    ends, data = np.frombuffer(word.buffers()[1], np.int32)[word.offset:word.offset + len(word) + 1], np.frombuffer(word.buffers()[2] or b"", np.uint8)
    first, last = data[ends[:-1]], data[ends[1:] - 1]
    gold = np.where((first >= ord("A")) & (first <= ord("Z")), 0, np.where((last == ord(".")) | (last == ord(",")), 1, 2))
    n = pc.utf8_length(word).to_numpy(zero_copy_only=False)
    fields = [""] + ["\t" + x for x in LABELS] + ["\t" + x + "\tX" for x in LABELS]
    code = np.where(n % 7 == 0, 0, np.where(n % 11 == 0, 4 + gold, 1 + gold))
    raw = pc.binary_join_element_wise(word, pa.array(fields).take(pa.array(code)), "")
    raw = pa.concat_arrays([raw, pa.array([""] * len(line), pa.string())])
    of_line = np.concatenate([of_line, np.arange(len(line))])
    order = np.argsort(of_line, kind="stable")
    return lists(np.searchsorted(of_line[order], offsets), raw.take(pa.array(order)))


def tag_lines(spark, sf):
    """A document per row, its tag lines an array."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return passed(d, lambda batch: rebuilt(batch, [], text=_tag_lines(batch["text"])), changed(d.schema, [], text=STRINGS))


def tag_tokens(spark, sf, default="O"):
    """A document per row: parallel arrays ``line_no, sent_no, token, label``."""
    t = sentence_ids(read_tagged(tag_lines(spark, sf), default), ["doc_id"])
    t = only(t, [c for c in t.columns if c != "n_fields"])
    return drop_lines(t, "is_blank", ["sent_no", "token", "label"], "line_no")


TOKEN = ["line_no", "sent_no", "token", "label"]


class Ctx:
    """Per-query stage cut. Documents are packed where they are read and their
    fragments assembled: one row per fragment, with the arrays of its tokens
    (``token`` with the unknown token in place, ``original`` what it replaced) and
    labels. This table is staged once in the shared folder, and the label and piece
    vocabularies are derived from it, so driver-side lookups never re-run the text
    pipeline."""

    def __init__(self, spark, sf, default="O"):
        checkpoint_dir(spark)
        self.spark, self.sf = spark, sf
        self.packed = stage_table(_fragments(spark, sf, default), "fragments")
        self._lv = None

    @property
    def tokens(self):
        """The tokens as they were read: the replaced ones are in ``original``."""
        return self.packed.select("token", "original")

    @property
    def labels(self):
        if self._lv is None:
            self._lv = label_vocab(self.packed.select(F.array_remove("label", "O").alias("label"))).cache()
        return self._lv


def packed(spark, sf, default="O"):
    u = unk_tokens(tag_tokens(spark, sf, default), TAG_MAX_LEN, PIECE_LEN, SPECIAL, original="original")
    return pack_fragments(u, ["doc_id", "lang", "sent_no"], BUDGET, carry=["token", "label", "original"])


def _fragments(spark, sf, default="O"):
    return assemble_sentences(packed(spark, sf, default), ["doc_id", "lang", "sent_no", "frag"], "line_no",
                              {"token": "token", "label": "label", "original": "original"}, number="n")


def sentences(spark, sf, ctx=None):
    p = (ctx or Ctx(spark, sf)).packed
    return p.select("doc_id", "lang", "sent_no", "frag", F.col("token").alias("words"), F.col("label").alias("labels"),
                    guid(F.col("lang"), F.col("doc_id"), F.col("n")).alias("guid"))


def labels_vocab(spark, sf):
    return Ctx(spark, sf).labels


# ----- SQL fragments ---------------------------------------------------------
def _sql_gold(w):
    return (f"(CASE WHEN substr({w}, 1, 1) BETWEEN 'A' AND 'Z' THEN 'B-CAP' "
            f"WHEN right({w}, 1) IN ('.', ',') THEN 'I-CAP' ELSE 'O' END)")


def _sql_raw(w):
    return (f"(CASE WHEN length({w}) % 7 = 0 THEN {w} "
            f"WHEN length({w}) % 11 = 0 THEN {w} || chr(9) || {_sql_gold(w)} || chr(9) || 'X' "
            f"ELSE {w} || chr(9) || {_sql_gold(w)} END)")


_ITEMS = sql_split_ws("text")
_SQL_WORDS = ("list_concat(list_filter(string_split(l, ' '), lambda q: q <> ''), "
              f"CASE WHEN length(replace(l, ' ', '')) > {LONG} THEN [replace(l, ' ', '')] ELSE [] END)")
SQL_TOK = f"""
tl AS (SELECT doc_id, lang, CAST(unnest(range(len(arr))) AS BIGINT) AS line_no, unnest(arr) AS text
       FROM (SELECT doc_id, lang, flatten(list_transform({sql_split_lines('text')},
                    lambda l: list_concat(list_transform({_SQL_WORDS}, lambda w: {_sql_raw('w')}), ['']))) AS arr
             FROM documents)),
tp AS (SELECT doc_id, lang, line_no, items, len(items) = 0 AS is_blank,
              items[1] AS token, CASE WHEN len(items) = 2 THEN items[2] WHEN len(items) > 0 THEN 'O' END AS label
       FROM (SELECT *, {_ITEMS} AS items FROM tl)),
ts AS (SELECT *, CAST(sum(CAST(is_blank AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(is_blank AS BIGINT) AS BIGINT) AS sent_no FROM tp),
tok AS (SELECT doc_id, lang, line_no, sent_no, token, label FROM ts WHERE NOT is_blank),
tn AS (SELECT *, CASE WHEN length(token) = 0 THEN 0 ELSE CAST({sql_piece_count('token', PIECE_LEN)} AS INTEGER) END AS n0 FROM tok),
tu AS (SELECT doc_id, lang, line_no, sent_no, label,
              CASE WHEN (n0 = 0 OR n0 > {BUDGET}) AND length(token) <> 0 THEN '{UNK}' ELSE token END AS token,
              CAST(CASE WHEN (n0 = 0 OR n0 > {BUDGET}) AND length(token) <> 0 THEN 1 ELSE n0 END AS INTEGER) AS n_pieces
       FROM tn)"""

SQL_PACK = SQL_TOK + f""",
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY line_no) AS k FROM tu),
rec AS (SELECT doc_id, sent_no, k, n_pieces AS cnt, 0 AS frag, 0 AS pos FROM tk WHERE k = 1
        UNION ALL
        SELECT tk.doc_id, tk.sent_no, tk.k,
               CASE WHEN rec.cnt + tk.n_pieces > {BUDGET} THEN tk.n_pieces ELSE rec.cnt + tk.n_pieces END,
               CASE WHEN rec.cnt + tk.n_pieces > {BUDGET} THEN rec.frag + 1 ELSE rec.frag END,
               CASE WHEN rec.cnt + tk.n_pieces > {BUDGET} THEN 0 ELSE rec.pos + 1 END
        FROM rec JOIN tk ON tk.doc_id = rec.doc_id AND tk.sent_no = rec.sent_no AND tk.k = rec.k + 1),
pk AS (SELECT tk.doc_id, tk.lang, tk.sent_no, tk.line_no, tk.n_pieces, tk.token, tk.label,
              CAST(rec.frag AS INTEGER) AS frag, CAST(rec.pos AS INTEGER) AS pos
       FROM tk JOIN rec ON tk.doc_id = rec.doc_id AND tk.sent_no = rec.sent_no AND tk.k = rec.k)"""

SQL_SENT = SQL_PACK + """,
sn AS (SELECT doc_id, lang, sent_no, frag, list(token ORDER BY line_no) AS words, list(label ORDER BY line_no) AS labels
       FROM pk GROUP BY doc_id, lang, sent_no, frag),
sg AS (SELECT *, concat_ws('-', lang, CAST(doc_id AS VARCHAR),
                           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_no, frag) AS VARCHAR)) AS guid FROM sn),
lv0 AS (SELECT DISTINCT label FROM tok WHERE label <> 'O'),
lv AS (SELECT 'O' AS label, 0 AS label_id UNION ALL
       SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS label_id FROM lv0)"""

register("tag_scan", f"""WITH {SQL_TOK}
SELECT doc_id, line_no, sent_no, token, label FROM tok""")(
    lambda spark, sf: token_rows(only(tag_tokens(spark, sf), ["doc_id", *TOKEN]), TOKEN))

register("tag_unk", f"""WITH {SQL_TOK}
SELECT doc_id, line_no, token, n_pieces FROM tu""")(
    lambda spark, sf: token_rows(only(unk_tokens(tag_tokens(spark, sf), TAG_MAX_LEN, PIECE_LEN, SPECIAL),
                                      ["doc_id", "line_no", "token", "n_pieces"]), ["line_no", "token", "n_pieces"]))

PACKED = ["sent_no", "line_no", "frag", "pos", "token", "label", "n_pieces"]

register("tag_pack", f"""WITH RECURSIVE {SQL_PACK}
SELECT doc_id, sent_no, line_no, frag, pos, token, label, n_pieces FROM pk""")(
    lambda spark, sf: token_rows(only(packed(spark, sf), ["doc_id", *PACKED]), PACKED))

register("tag_sentences", f"""WITH RECURSIVE {SQL_SENT}
SELECT guid, doc_id, sent_no, frag, words, labels FROM sg""")(
    lambda spark, sf: sentences(spark, sf).select("guid", "doc_id", "sent_no", "frag", "words", "labels"))

FILE_DOCS, FILE_BLOCK = 100, 64 << 10


def q_tag_files(spark, sf):
    """Tag lines of the documents, each behind a document mark, written to text
    files and read as preprocessed tag files in several blocks."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"tags-{uuid.uuid4().hex[:12]}")
    lines = tag_lines(spark, sf).select("doc_id", F.posexplode("text").alias("line_no", "text"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("long"))
    marks = table(spark, sf, "documents").select("doc_id", F.lit(-1).cast("long").alias("line_no"), F.lit("-DOCSTART- -X- O").alias("text"))
    rows = lines.union(marks).withColumn("file_no", F.floor(F.col("doc_id") / FILE_DOCS).cast("long"))
    write_line_files(rows, path, "file_no", ["doc_id", "line_no"])
    read = read_tokenized(read_lines(spark, path, with_block=True, block_bytes=FILE_BLOCK), "xx", ["file"])
    return read.select(file_value("file_no").cast("long").alias("file_no"), "guid", "words", "labels")


register("tag_files", f"""WITH {SQL_TOK},
fl AS (SELECT doc_id // {FILE_DOCS} AS file_no, doc_id, line_no, text, text = '' AS brk FROM tl
       UNION ALL SELECT doc_id // {FILE_DOCS}, doc_id, -1, '-DOCSTART- -X- O', true FROM documents),
fs AS (SELECT *, sum(CAST(brk AS BIGINT)) OVER (PARTITION BY file_no ORDER BY doc_id, line_no) AS sn FROM fl),
fw AS (SELECT file_no, sn, list(string_split(text, chr(9))[1] ORDER BY doc_id, line_no) AS words,
              list(CASE WHEN len(string_split(text, chr(9))) > 1 THEN string_split(text, chr(9))[-1] ELSE 'O' END ORDER BY doc_id, line_no) AS labels
       FROM fs WHERE NOT brk GROUP BY file_no, sn)
SELECT file_no, 'xx-' || row_number() OVER (PARTITION BY file_no ORDER BY sn) AS guid, words, labels FROM fw""")(q_tag_files)

register("label_vocab", f"""WITH {SQL_TOK},
lv0 AS (SELECT DISTINCT label FROM tok WHERE label <> 'O')
SELECT 'O' AS label, 0 AS label_id UNION ALL
SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS label_id FROM lv0""")(labels_vocab)


def q_lang_id(spark, sf):
    m = spark.createDataFrame(LANG2ID, "lang string, lang_id int")
    return lang_ids(table(spark, sf, "documents").select("doc_id", "lang"), m)


_L2I = " UNION ALL ".join(f"SELECT '{lg}' AS lang, {i} AS lang_id" for lg, i in LANG2ID)
_DEFAULT_ID = dict(LANG2ID)["en"]
register("lang_id", f"""WITH m AS ({_L2I})
SELECT d.doc_id, d.lang, coalesce(m.lang_id, {_DEFAULT_ID}) AS lang_id
FROM documents d LEFT JOIN m ON d.lang = m.lang""")(q_lang_id)


def labelled(spark, sf, ctx):
    """Sentences with the ids of their labels."""
    lmap = label_map(ctx.labels)
    return sentences(spark, sf, ctx).withColumn("label_ids", F.transform("labels", lambda x: F.element_at(lmap, x))).drop("labels")


def aligned(spark, sf, ctx=None):
    return _with_piece_labels(labelled(spark, sf, ctx or Ctx(spark, sf)))


def _with_piece_labels(s):
    return passed(s, lambda batch: rebuilt(batch, [], piece_labels=align_labels(batch["words"], batch["label_ids"], PIECE_LEN)),
                  changed(s.schema, [], piece_labels=INTS))


def _sql_npieces(w):
    return sql_piece_count(w, PIECE_LEN)


SQL_ALIGN = SQL_SENT + f""",
lm AS (SELECT map(list(label), list(label_id)) AS l2i, map(list(label_id), list(label)) AS i2l FROM lv),
al AS (SELECT sg.*, list_transform(labels, lambda x: l2i[x]) AS label_ids FROM sg, lm),
al2 AS (SELECT *, flatten(list_transform(list_zip(words, label_ids),
                 lambda z: list_concat([z[2]], list_transform(range({_sql_npieces('z[1]')} - 1), lambda q: {IGNORE}))))
                 AS piece_labels FROM al)"""

register("tag_align", f"""WITH RECURSIVE {SQL_ALIGN}
SELECT guid, label_ids, piece_labels FROM al2""")(
    lambda spark, sf: only(aligned(spark, sf), ["guid", "label_ids", "piece_labels"]))


def features(spark, sf, ctx=None, wanted=None, **layout):
    """Features of all sentences, or of the languages ``wanted(lang)``. Encoding
    moves words by number and labels by id; labels follow from the words again."""
    ctx = ctx or Ctx(spark, sf)
    a = labelled(spark, sf, ctx)
    if wanted is not None:
        keys = wanted.select(F.col("lang").alias("__wanted")).distinct()
        a = a.join(keys, a["lang"].eqNullSafe(keys["__wanted"]), "left_semi")
    vocab = build_vocab(ctx.tokens, ["token", "original"], VOCAB_SIZE, PIECE_LEN)
    pcs = _with_piece_labels(encode_word_arrays(a, vocab, {"piece_ids": "words"}, PIECE_LEN))
    names = id_map(ctx.labels)
    pcs = pcs.withColumn("labels", F.transform("label_ids", lambda x: F.element_at(names, x)))
    m = spark.createDataFrame(LANG2ID, "lang string, lang_id int")
    pcs = lang_ids(pcs, m)
    return pcs.select("guid", "doc_id", "lang", "sent_no", "frag", "words", "labels",
                      *tag_features(F.col("piece_ids"), F.col("piece_labels"), F.col("lang_id"), TAG_MAX_LEN, **layout))


_WP = sql_word_pieces("w", PIECE_LEN)


def _sql_padded(a, v):
    return f"list_concat({a}, list_transform(range(greatest({TAG_MAX_LEN} - len({a}), 0)), lambda q: {v}))"


SQL_FEAT = SQL_ALIGN + "," + sql_vocab("tok", "token", VOCAB_SIZE, PIECE_LEN, name="tv") + f""",
fp AS (SELECT guid, unnest(range(len(pc))) AS k, unnest(pc) AS piece
       FROM (SELECT guid, flatten(list_transform(words, lambda w: {_WP})) AS pc FROM al2)),
fi AS (SELECT fp.guid, list(coalesce(tv.piece_id, {UNK_ID}) ORDER BY fp.k) AS piece_ids
       FROM fp LEFT JOIN tv ON fp.piece = tv.piece GROUP BY fp.guid),
l2i AS ({_L2I}),
fx AS (SELECT al2.*, fi.piece_ids, coalesce(l2i.lang_id, {_DEFAULT_ID}) AS lang_id,
              list_concat([{BOS_ID}], fi.piece_ids[1:{TAG_MAX_LEN - SPECIAL}], [{EOS_ID}, {EOS_ID}]) AS ids,
              list_concat([{IGNORE}], piece_labels[1:{TAG_MAX_LEN - SPECIAL}], [{IGNORE}, {IGNORE}]) AS labs
       FROM al2 JOIN fi ON al2.guid = fi.guid LEFT JOIN l2i ON al2.lang = l2i.lang),
feat AS (SELECT guid, doc_id, lang, sent_no, frag, words, labels,
                {_sql_padded('ids', PAD_ID)} AS input_ids,
                {_sql_padded('list_transform(ids, lambda q: 1)', 0)} AS input_mask,
                {_sql_padded('list_transform(ids, lambda q: 0)', 0)} AS segment_ids,
                {_sql_padded('labs', IGNORE)} AS label_ids,
                list_transform(range({TAG_MAX_LEN}), lambda q: lang_id) AS langs
         FROM fx)"""

register("tag_features", f"""WITH RECURSIVE {SQL_FEAT}
SELECT guid, input_ids, input_mask, segment_ids, label_ids, langs FROM feat""")(
    lambda spark, sf: features(spark, sf).select("guid", "input_ids", "input_mask", "segment_ids", "label_ids",
                                                 "langs"))


def q_tag_features_pos(spark, sf):
    """Part-of-speech tagging: a missing label is ``X``; one separator, the start
    token last, padding on the left."""
    f = features(spark, sf, Ctx(spark, sf, "X"), sep_token_extra=False, cls_at_end=True, pad_on_left=True)
    return f.select("guid", "input_ids", "input_mask", "segment_ids", "label_ids", "langs")


def _sql_left(a, v):
    return f"list_concat(list_transform(range(greatest({TAG_MAX_LEN} - len({a}), 0)), lambda q: {v}), {a})"


_POS = SQL_FEAT.replace("WHEN len(items) > 0 THEN 'O' END AS label", "WHEN len(items) > 0 THEN 'X' END AS label")
register("tag_features_pos", f"""WITH RECURSIVE {_POS},
fy AS (SELECT guid, lang_id, list_concat(piece_ids[1:{TAG_MAX_LEN - 2}], [{EOS_ID}, {BOS_ID}]) AS ids,
              list_concat(piece_labels[1:{TAG_MAX_LEN - 2}], [{IGNORE}, {IGNORE}]) AS labs FROM fx)
SELECT guid, {_sql_left('ids', PAD_ID)} AS input_ids,
       {_sql_left('list_transform(ids, lambda q: 1)', 0)} AS input_mask,
       {_sql_left('list_transform(ids, lambda q: 0)', 0)} AS segment_ids,
       {_sql_left('labs', IGNORE)} AS label_ids, list_transform(range({TAG_MAX_LEN}), lambda q: lang_id) AS langs
FROM fy""")(q_tag_features_pos)


# ----- predictions, decoding, spans, realignment ----------------------------
PLACES = [str(j).encode() for j in range(TAG_MAX_LEN)]


def decoded(spark, sf, ctx=None):
    ctx = ctx or Ctx(spark, sf)
    names = id_names(ctx.labels)
    n_lab = len(names)
    by_pred = np.array([[1.0 if c == p else c * 0.1 for c in range(n_lab)] for p in range(n_lab)])
    keys = ["guid", "doc_id", "lang", "sent_no", "frag"]

    def pred_ids(guids, gold):
        """A label flips with its draw; what is ignored is predicted as 0."""
        offsets, g = flat(gold)
        g = g.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(g != IGNORE)
        row = np.searchsorted(offsets, at, side="right") - 1
        first = [f"{PRED_SEED}:{x}:".encode() for x in guids.to_pylist()]
        drawn = uniforms([first[r] + PLACES[j] for r, j in zip(row.tolist(), (at - offsets[row]).tolist())])
        pred = np.zeros(len(g), np.int64)
        pred[at] = np.where(drawn < FLIP_P, (g[at] + 1) % n_lab, g[at])
        return offsets, pred

    def of(batch):
        # predictions depend on the label layout of the features only
        gold_ids = feature_labels(batch["piece_labels"], TAG_MAX_LEN)
        offsets, pred = pred_ids(batch["guid"], gold_ids)
        logits = lists(np.arange(len(pred) + 1) * n_lab, pa.array(by_pred[pred].reshape(-1)))
        gold, found = decode_predictions(lists(offsets, argmax(logits)), gold_ids, names)
        return rebuilt(batch.select(keys), [], gold_labels=gold, pred_labels=found)
    f = aligned(spark, sf, ctx)
    return passed(f, of, changed(T.StructType([f.schema[k] for k in keys]), [], gold_labels=STRINGS, pred_labels=STRINGS))


def _u(*parts):
    return sql_uniform(sql_key(str(PRED_SEED), *parts))


SQL_DEC = SQL_FEAT + f""",
nl AS (SELECT count(*) AS n_lab FROM lv),
pr AS (SELECT feat.*, list_transform(range(len(label_ids)), lambda j:
          CASE WHEN label_ids[j + 1] = {IGNORE} THEN 0
               WHEN {_u('guid', 'j')} < {FLIP_P} THEN (label_ids[j + 1] + 1) % n_lab
               ELSE label_ids[j + 1] END) AS pid
       FROM feat, nl),
lg AS (SELECT pr.*, list_transform(range(len(pid)), lambda j: list_transform(range(n_lab), lambda c:
          CASE WHEN c = pid[j + 1] THEN 1.0 ELSE c * 0.1 END)) AS logits
       FROM pr, nl),
pd AS (SELECT lg.*, list_transform(logits, lambda l: CAST(list_position(l, list_max(l)) - 1 AS INTEGER)) AS pred_ids
       FROM lg),
dz AS (SELECT pd.*, list_filter(list_zip(label_ids, pred_ids), lambda z: z[1] <> {IGNORE}) AS zz FROM pd),
dec AS (SELECT guid, doc_id, lang, sent_no, frag,
               list_transform(zz, lambda z: i2l[z[1]]) AS gold_labels,
               list_transform(zz, lambda z: i2l[z[2]]) AS pred_labels
        FROM dz, lm)"""

register("tag_decode", f"""WITH RECURSIVE {SQL_DEC}
SELECT guid, gold_labels, pred_labels FROM dec""")(
    lambda spark, sf: only(decoded(spark, sf), ["guid", "gold_labels", "pred_labels"]))


def _sql_spans(src, keys, pos, label, out):
    """SQL twin of :func:`tessera.operators.tag_metrics.spans`."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""
{out}_b AS (SELECT {k}, CAST({pos} AS BIGINT) AS pos, {label} AS label FROM {src}
            UNION ALL SELECT {k}, max(CAST({pos} AS BIGINT)) + 1, 'O' FROM {src} GROUP BY {k}),
{out}_t AS (SELECT *, substr(label, 1, 1) AS tag,
                   coalesce(nullif(CASE WHEN instr(substr(label, 2), '-') > 0
                                        THEN substr(substr(label, 2), instr(substr(label, 2), '-') + 1)
                                        ELSE substr(label, 2) END, ''), '_') AS typ FROM {out}_b),
{out}_l AS (SELECT *, coalesce(lag(tag) OVER (PARTITION BY {k} ORDER BY pos), 'O') AS ptag,
                   coalesce(lag(typ) OVER (PARTITION BY {k} ORDER BY pos), '_') AS ptyp FROM {out}_t),
{out}_f AS (SELECT *,
       (ptag = 'E' OR ptag = 'S' OR (ptag IN ('B', 'I') AND tag IN ('B', 'S', 'O'))
        OR (ptag <> 'O' AND ptag <> '.' AND ptyp <> typ)) AS is_end,
       (tag IN ('B', 'S') OR (ptag IN ('E', 'S', 'O') AND tag IN ('E', 'I'))
        OR (tag <> 'O' AND tag <> '.' AND ptyp <> typ)) AS is_start FROM {out}_l),
{out}_g AS (SELECT *, coalesce(max(CASE WHEN is_start THEN pos END) OVER (PARTITION BY {k} ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM {out}_f),
{out} AS (SELECT {k}, ptyp AS span_type, CAST(begin AS BIGINT) AS start, pos - 1 AS "end" FROM {out}_g WHERE is_end)"""


def q_tag_spans(spark, sf):
    s = assemble_sentences(tag_tokens(spark, sf), ["doc_id", "sent_no"], "line_no", {"label": "label", "line_no": "line_no"})
    return spans(s, ["doc_id", "sent_no"], pos_col="line_no")


register("tag_spans", f"""WITH {SQL_TOK},
{_sql_spans('tok', ['doc_id', 'sent_no'], 'line_no', 'label', 'sp')}
SELECT doc_id, sent_no, span_type, start, "end" FROM sp""")(q_tag_spans)


def _span_report(spark, sf, mode):
    per = prf(span_counts(decoded(spark, sf), "gold_labels", "pred_labels", ["lang"], mode))
    langs = spark.createDataFrame([(x,) for x in REPORT_LANGS], "lang string")
    j = langs.join(per, on="lang", how="left")
    # an empty evaluation reports every metric as 0
    return j.select("lang", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_gold", "n_pred", "tp")],
                    *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in ("precision", "recall", "f1")])


def q_tag_span_f1(spark, sf):
    return _span_report(spark, sf, "conll")


def q_tag_span_strict(spark, sf):
    return _span_report(spark, sf, STRICT)


_RL = " UNION ALL ".join(f"SELECT '{x}' AS lang" for x in REPORT_LANGS)
_SPAN_SIDES = f"""
gx AS (SELECT guid, lang, unnest(range(len(gold_labels))) AS pos, unnest(gold_labels) AS label FROM dec),
px AS (SELECT guid, lang, unnest(range(len(pred_labels))) AS pos, unnest(pred_labels) AS label FROM dec),
{_sql_spans('gx', ['guid', 'lang'], 'pos', 'label', 'gsp')},
{_sql_spans('px', ['guid', 'lang'], 'pos', 'label', 'psp')}"""


def _sql_strict(src, spans_cte, out):
    """Spans that open with B and go on with I of their type."""
    return f"""
{out} AS (SELECT s.guid, s.lang, s.span_type, s.start, s."end" FROM {spans_cte} s
          JOIN {src} x ON x.guid = s.guid AND x.pos BETWEEN s.start AND s."end" GROUP BY ALL
          HAVING bool_and(x.label = CASE WHEN x.pos = s.start THEN 'B-' ELSE 'I-' END || s.span_type))"""


def _sql_span_report(gold, pred):
    return f"""
j AS (SELECT coalesce(g.lang, p.lang) AS lang, g.guid AS g, p.guid AS p
      FROM {gold} g FULL OUTER JOIN {pred} p ON g.guid = p.guid AND g.span_type = p.span_type
                                 AND g.start = p.start AND g."end" = p."end"),
a AS (SELECT lang, count(g) AS n_gold, count(p) AS n_pred, count(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN 1 END) AS tp
      FROM j GROUP BY lang),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0.0 END AS recall FROM a),
rl AS ({_RL})
SELECT rl.lang, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp,
       round(coalesce(precision, 0.0), 6) AS precision, round(coalesce(recall, 0.0), 6) AS recall,
       round(coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END,
                      0.0), 6) AS f1
FROM rl LEFT JOIN m ON rl.lang = m.lang"""


register("tag_span_f1", f"""WITH RECURSIVE {SQL_DEC},{_SPAN_SIDES},{_sql_span_report("gsp", "psp")}""")(q_tag_span_f1)
register("tag_span_strict", f"""WITH RECURSIVE {SQL_DEC},{_SPAN_SIDES},{_sql_strict("gx", "gsp", "gst")},{_sql_strict("px", "psp", "pst")},
{_sql_span_report("gst", "pst")}""")(q_tag_span_strict)


def q_tag_span_arrays(spark, sf):
    """The spans of :func:`q_tag_spans`, numbered by token, from label arrays."""
    s = assemble_sentences(tag_tokens(spark, sf), ["doc_id", "sent_no"], "line_no", {"labels": "label"})
    keys = ["doc_id", "sent_no"]

    def of(batch):
        offsets, found = flat(array_spans(batch["labels"]))
        at = pa.array(np.repeat(np.arange(len(batch)), np.diff(offsets)))
        return rebuilt(batch.select(keys).take(at), [], **{n: found.field(n) for n in ("span_type", "start", "end")})
    return passed(s, of, changed(T.StructType([s.schema[k] for k in keys]), [], span_type=STRING, start=T.LongType(), end=T.LongType()))


register("tag_span_arrays", f"""WITH {SQL_TOK},
tq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY line_no) - 1 AS pos FROM tok),
{_sql_spans('tq', ['doc_id', 'sent_no'], 'pos', 'label', 'sp')}
SELECT doc_id, sent_no, span_type, start, "end" FROM sp""")(q_tag_span_arrays)


def q_tag_realign(spark, sf):
    """Every fragment with an even number of tokens lacks its last prediction,
    as a model that truncates leaves it."""
    ctx = Ctx(spark, sf)
    d = only(decoded(spark, sf, ctx), ["doc_id", "sent_no", "frag", "pred_labels"])

    def of(batch):
        offsets, labels = flat(batch["pred_labels"])
        last = offsets[1:][(np.diff(offsets) % 2 == 0) & (np.diff(offsets) > 0)] - 1
        stay = np.ones(len(labels), bool)
        stay[last] = False
        ends = np.concatenate([[0], np.cumsum(stay)])[offsets]
        return rebuilt(batch, ["pred_labels"], preds=lists(ends, labels.filter(pa.array(stay))))
    return realign(passed(d, of, changed(d.schema, ["pred_labels"], preds=STRINGS)), ctx.packed, ["doc_id", "sent_no"])


register("tag_realign", f"""WITH RECURSIVE {SQL_DEC},
dx AS (SELECT doc_id, sent_no, frag, unnest(range(len(pl))) AS pos, unnest(pl) AS pred
       FROM (SELECT *, pred_labels[1:CASE WHEN len(pred_labels) % 2 = 0 THEN len(pred_labels) - 1 ELSE len(pred_labels) END] AS pl FROM dec)),
jj AS (SELECT pk.doc_id, pk.sent_no, pk.frag, pk.pos, pk.token, dx.pred FROM pk
       LEFT JOIN dx ON pk.doc_id = dx.doc_id AND pk.sent_no = dx.sent_no AND pk.frag = dx.frag AND pk.pos = dx.pos)
SELECT doc_id, sent_no, list(token ORDER BY frag, pos) AS tokens, list(pred ORDER BY frag, pos) AS preds
FROM jj GROUP BY doc_id, sent_no""")(q_tag_realign)


def q_few_shot(spark, sf):
    s = assign_split(sentences(spark, sf), ["doc_id"], seed=SPLIT_SEED).filter(F.col("split") == "train")
    r = row_numbers(s.select("guid", "doc_id", "sent_no", "frag"),
                    [F.col("doc_id"), F.col("sent_no"), F.col("frag")], out="ord")
    return few_shot(r, FEW_SHOT_N).select("guid", "ord")


_US = sql_uniform(sql_key(str(SPLIT_SEED), "doc_id"))
register("few_shot", f"""WITH RECURSIVE {SQL_SENT},
tr AS (SELECT guid, CAST(row_number() OVER (ORDER BY doc_id, sent_no, frag) - 1 AS BIGINT) AS ord
       FROM sg WHERE {_US} < 0.8)
SELECT guid, ord FROM tr WHERE ord < {FEW_SHOT_N}""")(q_few_shot)


def q_lang_union(spark, sf):
    """All languages that the data have, read once; a null language is kept."""
    return sentences(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"),
                                                    F.sum(F.size("words")).alias("n_tokens"))


register("lang_union", f"""WITH RECURSIVE {SQL_SENT}
SELECT lang, count(*) AS n_sentences, sum(len(words)) AS n_tokens FROM sg GROUP BY lang""")(q_lang_union)


def q_feature_cache(spark, sf):
    """Features cached by (mode, lang, model, max_len): the first request builds
    one language, the second all others, the third reads what lies there."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"features-{uuid.uuid4().hex[:12]}")
    langs = table(spark, sf, "documents").select("lang").distinct()
    wanted = langs.select(F.lit("test").alias("mode"), "lang", F.lit("pieces-4").alias("model"), F.lit(TAG_MAX_LEN).alias("max_len"))

    ctx = Ctx(spark, sf)

    def build(keys):
        f = features(spark, sf, ctx, wanted=keys)
        keys = keys.withColumnRenamed("lang", "wanted_lang")
        return f.join(keys, f["lang"].eqNullSafe(keys["wanted_lang"])).drop("wanted_lang")

    english = wanted.filter(F.col("lang") == "en")
    for some in (english, wanted):
        cached_features(spark, path, some, build)
    return cached_features(spark, path, english, build).select("guid", "input_ids", "label_ids")


register("feature_cache", f"""WITH RECURSIVE {SQL_FEAT}
SELECT guid, input_ids, label_ids FROM feat WHERE lang = 'en'""")(q_feature_cache)
