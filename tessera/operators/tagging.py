"""Sequence-tagging data preparation and prediction handling.

Token rows are keyed ``(file, line_no)``; a sentence is a run of token lines
between blank lines (W1). Greedy packing of sentences is in
:mod:`tessera.operators.fragments`. Where a row is a whole file, with its lines
as an array, the same functions take and give parallel arrays
(:mod:`tessera.operators.tag_arrays`) and nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import split_ws
from tessera.operators.tag_arrays import aligned_pieces, blanks_before, cut_labels, is_array, only, run_rows, scored, tag_fields, unk_arrays, written, zipped
from tessera.operators.vocab import BOS_ID, EOS_ID, PAD_ID, UNK, piece_count

IGNORE = -100


def read_tagged(lines: DataFrame, default_label: str = "O") -> DataFrame:
    """Raw tag file rows: strip, whitespace split; token = first field, label
    = second field only when the line has exactly two fields, else the
    default (``O`` for NER, ``X`` for POS). Blank lines get null token and
    ``is_blank``; ``n_fields`` is kept so silently defaulted labels can be
    counted. A ``text`` of arrays is a file per row, and so are the results."""
    if is_array(lines, "text"):
        return tag_fields(lines, default_label)
    items = split_ws("text")
    return lines.withColumn("__it", items).select(
        *[c for c in lines.columns if c != "text"],
        (F.size("__it") == 0).alias("is_blank"),
        F.size("__it").alias("n_fields"),
        F.when(F.size("__it") > 0, F.col("__it")[0]).alias("token"),
        F.when(F.size("__it") == 2, F.col("__it")[1])
         .when(F.size("__it") > 0, F.lit(default_label)).alias("label"))


def sentence_ids(df: DataFrame, file_cols: list[str], order_col: str = "line_no",
                 blank_col: str = "is_blank", out: str = "sent_no",
                 block_col: str | None = None) -> DataFrame:
    """Gaps and islands: ``sent_no`` = number of blank lines before the row
    in file order, so consecutive token lines share a number.

    With ``block_col`` (the scan block of a huge file) the count is two-level:
    blanks per block → offsets over the tiny block table → in-block running
    count, so no window spans a whole file. A ``blank_col`` of arrays is a file
    per row."""
    if is_array(df, blank_col):
        return blanks_before(df, blank_col, out)
    flag = F.col(blank_col).cast("long")
    if block_col is None:
        w = Window.partitionBy(*file_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, (F.sum(flag).over(w) - flag).cast("long"))
    per = df.groupBy(*file_cols, block_col).agg(F.sum(flag).alias("__b"))
    wb = Window.partitionBy(*file_cols).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*file_cols, block_col, F.coalesce(F.sum("__b").over(wb), F.lit(0)).alias("__off"))
    w = Window.partitionBy(*file_cols, block_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(offs, on=file_cols + [block_col])
            .withColumn(out, (F.col("__off") + F.sum(flag).over(w) - flag).cast("long")).drop("__off"))


def unk_tokens(df: DataFrame, max_len: int, piece_len: int, special_count: int = 3,
               token: str = "token", original: str | None = None) -> DataFrame:
    """Piece count per token; a token with no piece or more pieces than the
    budget ``max_len - special_count`` becomes the unknown token (1 piece).
    ``original`` keeps a token that was replaced (null elsewhere). A ``token``
    of arrays gives arrays."""
    budget = max_len - special_count
    if is_array(df, token):
        return unk_arrays(df, token, budget, piece_len, UNK, original)
    n = piece_count(F.col(token), piece_len)
    bad = ((n == 0) | (n > budget)) & (F.length(token) != 0)
    # the flag is taken from the original token, before it is replaced
    df = df.withColumn("__n", n).withColumn("__bad", bad)
    if original:
        df = df.withColumn(original, F.when(F.col("__bad"), F.col(token)))
    return (df.withColumn(token, F.when(F.col("__bad"), F.lit(UNK)).otherwise(F.col(token)))
            .withColumn("n_pieces", F.when(F.col("__bad"), F.lit(1)).otherwise(F.col("__n")).cast("int"))
            .drop("__n", "__bad"))


def assemble_sentences(df: DataFrame, keys: list[str], order_col: str, cols: dict[str, str], number: str | None = None) -> DataFrame:
    """Ordered arrays per sentence (``cols``: output array → row column). With
    ``order_col`` an array, a row is a file whose lines are in order; a sentence is
    then a run of equal keys, and ``number`` its 1-based number in the file."""
    if is_array(df, order_col):
        return run_rows(df, keys, cols, number)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                *[F.col(c).alias(c) for c in cols.values()])))
    g = df.groupBy(*keys).agg(rows.alias("__rows"))
    return g.select(*keys, *[F.transform("__rows", _field(c)).alias(o) for o, c in cols.items()])


def _field(name: str):
    return lambda r: r[name]


def guid(lang: Column, *parts: Column) -> Column:
    """Sentence id ``lang-...-n``."""
    return F.concat_ws("-", lang, *[p.cast("string") for p in parts])


def label_vocab(labels: DataFrame, label_col: str = "label", limit: int = 100_000) -> DataFrame:
    """Sorted label list with ``O`` put first when absent; id = position.

    A label inventory is small whatever the corpus size (the distinct step
    runs distributed; only the distinct labels reach the driver, with a
    size check). A column of label arrays is taken as it is."""
    spark = labels.sparkSession
    if is_array(labels, label_col):
        labels = labels.select(F.explode(F.array_distinct(label_col)).alias(label_col))
    rows = labels.select(label_col).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("label inventory is larger than a label vocabulary can be")
    names = sorted(r[0] for r in rows if r[0] is not None)
    if "O" not in names:
        names = ["O"] + names
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, label_id int")


def label_map(vocab: DataFrame) -> Column:
    """``label → id`` map literal from a (small) label vocabulary."""
    rows = vocab.select("label", "label_id").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("label vocabulary too large for a map literal")
    return F.create_map(*[x for r in rows for x in (F.lit(r["label"]), F.lit(int(r["label_id"])))])


def id_names(vocab: DataFrame) -> dict[int, str]:
    """``id → label`` of the whole (small) vocabulary."""
    return {int(r["label_id"]): r["label"] for r in vocab.select("label", "label_id").collect()}


def id_map(vocab: DataFrame) -> Column:
    """``id → label`` map literal of the whole vocabulary."""
    return F.create_map(*[x for i, name in id_names(vocab).items() for x in (F.lit(i), F.lit(name))])


def align_labels(words, label_ids, piece_len: int):
    """Piece-level labels: the word's label on its first piece, the ignore
    id on the following pieces. Columns give a column, the Arrow arrays of a pass
    an array; so do the functions below that say so."""
    if isinstance(words, pa.Array):
        return aligned_pieces(words, label_ids, piece_len, UNK, IGNORE)

    @F.arrow_udf("array<int>")
    def of(w: pa.Array, ids: pa.Array) -> pa.Array:
        return aligned_pieces(w, ids, piece_len, UNK, IGNORE)
    return of(words, label_ids)


def tag_features(piece_ids: Column, piece_labels: Column, lang_id: Column, max_len: int,
                 sep_token_extra: bool = True, cls_at_end: bool = False,
                 pad_on_left: bool = False) -> list[Column]:
    """Model inputs of exactly ``max_len``: truncate to ``max_len - 3`` (extra
    separator on), separator(s), start token first (or last), segment ids,
    input mask, padding; the language id repeated."""
    special = 3 if sep_token_extra else 2
    ids = F.slice(piece_ids, 1, max_len - special)
    labs = F.slice(piece_labels, 1, max_len - special)
    seps = [EOS_ID] * (2 if sep_token_extra else 1)
    ids = F.concat(ids, F.array(*[F.lit(x) for x in seps]))
    labs = F.concat(labs, F.array(*[F.lit(IGNORE) for _ in seps]))
    if cls_at_end:
        ids = F.concat(ids, F.array(F.lit(BOS_ID)))
        labs = F.concat(labs, F.array(F.lit(IGNORE)))
    else:
        ids = F.concat(F.array(F.lit(BOS_ID)), ids)
        labs = F.concat(F.array(F.lit(IGNORE)), labs)
    n = F.size(ids)
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))

    def padded(a, v):
        fill = F.array_repeat(F.lit(v), pad)
        return F.concat(fill, a) if pad_on_left else F.concat(a, fill)
    return [padded(ids, PAD_ID).alias("input_ids"),
            padded(F.array_repeat(F.lit(1), n), 0).alias("input_mask"),
            padded(F.array_repeat(F.lit(0), n), 0).alias("segment_ids"),
            padded(labs, IGNORE).alias("label_ids"),
            F.array_repeat(lang_id, max_len).alias("langs")]


def feature_labels(piece_labels, max_len: int, sep_token_extra: bool = True):
    """The ``label_ids`` array of :func:`tag_features` alone (it depends on the
    piece labels only): what prediction decoding needs, without encoding the
    input pieces. Takes a column or an Arrow array."""
    if isinstance(piece_labels, pa.Array):
        return cut_labels(piece_labels, max_len, 3 if sep_token_extra else 2, IGNORE)
    f = tag_features(piece_labels, piece_labels, F.lit(0), max_len, sep_token_extra)
    return f[3]


def decode_predictions(pred_ids, gold_ids, id_to_label) -> tuple:
    """Keep positions whose gold id is not the ignore id; map ids to names
    for gold and prediction alike. Takes columns and a map column, or Arrow arrays
    and a dict; the ids of columns are mapped in the plan."""
    if isinstance(pred_ids, pa.Array):
        return scored(pred_ids, gold_ids, id_to_label, IGNORE)
    z = F.filter(F.arrays_zip(gold_ids.alias("g"), F.slice(pred_ids, 1, F.size(gold_ids)).alias("p")), lambda x: x["g"] != IGNORE)
    return tuple(F.transform(F.transform(z, _field(side)), lambda x: F.element_at(id_to_label, x)) for side in ("g", "p"))


def realign(frag_preds: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """Fragment-level predictions back to original sentences: the tokens of a
    fragment (``token`` of rows with a ``pos``, or an array) and its predictions
    (``keys + frag``, array ``preds``), both written as strings, meet in their
    sentence by one shuffle, and are zipped by position, the fragments in order.
    Every token stays: one without a prediction gets null; predictions beyond the
    tokens are dropped."""
    if is_array(packed, "token"):
        frags = packed.select(*keys, "frag", F.col("token").alias("__t"))
    else:
        rows = F.array_sort(F.collect_list(F.struct("pos", "token")))
        frags = packed.groupBy(*keys, "frag").agg(rows.alias("__r")).select(*keys, "frag", F.transform("__r", lambda r: r["token"]).alias("__t"))
    none = F.lit(None).cast("string")
    said = written(only(frag_preds, [*keys, "frag", "preds"]), ["preds"])
    both = written(frags, ["__t"]).withColumn("__p", none).unionByName(said.select(*keys, "frag", none.alias("__t"), F.col("preds").alias("__p")))
    j = both.repartition(*[F.col(k) for k in keys]).groupBy(*keys, "frag").agg(
        F.first("__t", ignorenulls=True).alias("__t"), F.first("__p", ignorenulls=True).alias("__p")).filter(F.col("__t").isNotNull())
    sents = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frag", F.col("__t").alias("t"), F.col("__p").alias("p")))).alias("__f"))
    return zipped(sents, keys, "__f")


def lang_ids(df: DataFrame, lang2id: DataFrame | None, lang_col: str = "lang",
             default_lang: str = "en") -> DataFrame:
    """Language id with the default language's id as fallback; 0 when no
    map is given."""
    if lang2id is None:
        return df.withColumn("lang_id", F.lit(0))
    m = lang2id.select(F.col("lang").alias("__l"), F.col("lang_id").alias("__id"))
    d = lang2id.filter(F.col("lang") == default_lang).select("lang_id").first()
    dflt = F.lit(int(d[0]) if d is not None else 0)
    j = df.join(m, df[lang_col] == m["__l"], "left")
    return j.withColumn("lang_id", F.coalesce(F.col("__id"), dflt)).drop("__l", "__id")


def few_shot(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """First ``n`` examples by an ordered key; ``n = -1`` keeps all."""
    return df if n < 0 else df.filter(F.col(ord_col) < n)


def union_langs(frames: dict[str, DataFrame]) -> DataFrame:
    """Concatenate per-language tables (``lang → frame``) by column name."""
    out = None
    for lang, f in frames.items():
        f = f.withColumn("lang", F.lit(lang)) if "lang" not in f.columns else f
        out = f if out is None else out.unionByName(f)
    return out


def sentence_order(lines: DataFrame, file_cols: list[str], is_break: Column, block_col: str = "block",
                   order_col: str = "line_no", out: str = "sent_no") -> DataFrame:
    """1-based number, within its file, of the sentence that a line belongs to:
    sentences are runs of lines between breaks.

    Windows span one scan block at most. A block tells how many sentences start
    inside it, whether its first line is a token and whether its last line is a
    break; over this table of blocks an open sentence is carried from one block
    to the next, and the starts are summed."""
    rows = lines.withColumn("__brk", is_break)
    w = Window.partitionBy(*file_cols, block_col).orderBy(order_col)
    before = F.lag("__brk").over(w)
    rows = rows.withColumn("__head", before.isNull()).withColumn("__start", (~F.col("__brk") & F.coalesce(before, F.lit(False))).cast("long"))
    blocks = rows.groupBy(*file_cols, block_col).agg(
        F.sum("__start").alias("starts"), F.max(F.col("__head") & ~F.col("__brk")).alias("token_first"),
        F.max_by("__brk", order_col).alias("ends"))
    wf = Window.partitionBy(*file_cols).orderBy(block_col)
    opens = (F.col("token_first") & F.coalesce(F.lag("ends").over(wf), F.lit(True))).cast("long")
    blocks = blocks.withColumn("opens", opens)
    earlier = F.coalesce(F.sum(F.col("starts") + F.col("opens")).over(wf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*file_cols, block_col, (earlier + F.col("opens")).alias("__base"))
    running = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", running).join(blocks, [*file_cols, block_col]) \
               .withColumn(out, (F.col("__base") + F.col("__run")).cast("long")).drop("__head", "__start", "__run", "__base")


def read_tokenized(lines: DataFrame, lang: str | Column, file_cols: list[str], block_col: str = "block") -> DataFrame:
    """Preprocessed tag file: tab-split, first field word, last field label
    (``O`` when missing); blank or ``-DOCSTART-`` lines end a sentence.
    Returns one row per non-empty sentence: ``guid, words, labels``; without a
    ``block_col`` a file counts as one block."""
    if block_col not in lines.columns:
        lines = lines.withColumn(block_col, F.lit(0))
    t = sentence_order(lines, file_cols, (F.col("text") == "") | F.col("text").startswith("-DOCSTART-"), block_col)
    parts = F.split("text", "\t", -1)
    tok = t.filter(~F.col("__brk")).select(
        *file_cols, "line_no", "sent_no", parts[0].alias("word"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("O")).alias("label"))
    s = assemble_sentences(tok, file_cols + ["sent_no"], "line_no", {"words": "word", "labels": "label"})
    return s.withColumn("guid", guid(lang if isinstance(lang, Column) else F.lit(lang), F.col("sent_no")))
