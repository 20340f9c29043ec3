"""Span extraction from tag sequences and micro span precision/recall/F1.

Span rule (CoNLL-style, non-strict, as the common evaluation package does):
prefix = first character of the tag, type = the text after the first ``-``
of the rest (or the rest itself; ``_`` when empty). With ``prev`` the
previous token (``O``/``_`` before the first):

* a span **ends** before token i when prev prefix is ``E`` or ``S``; or prev
  is ``B``/``I`` and the prefix is ``B``, ``S`` or ``O``; or prev is not
  ``O``/``.`` and the type changes;
* a span **starts** at i when the prefix is ``B`` or ``S``; or prev is
  ``E``/``S``/``O`` and the prefix is ``E`` or ``I``; or the prefix is not
  ``O``/``.`` and the type changes.

A sentinel ``O`` closes every sentence; spans never cross sentences. The
rule looks at neighbouring tokens only, so it runs as a finite-state pass over
label arrays, all sentences of an Arrow batch at once: :func:`array_spans`
gives the spans of a column, :func:`span_counts` those of gold and prediction
together, counted where they are, so that only one row per batch and group is
shuffled. :func:`spans` and :func:`span_prf` are the same rule over token rows,
as window arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tessera.operators.tag_arrays import LONG, STRING, changed, flat, is_array, only, passed, rebuilt

CONLL, STRICT = "conll", "strict_bio"


def _split_label(label: str | None) -> tuple[str, str]:
    """Prefix and type of a tag; a null tag is outside."""
    rest = (label or "O")[1:]
    return (label or "O")[:1], rest.split("-", 1)[-1] or "_"


def find_spans(labels: pa.Array, mode: str = CONLL):
    """``(row, type, start, end, types)`` of all spans in an array of label
    arrays: positions are inclusive, ``type`` indexes ``types``.

    ``strict_bio`` keeps spans that open with ``B`` and go on with ``I`` of the
    same type only."""
    return _found(labels, mode)[:5]


def _found(labels: pa.Array, mode: str):
    """:func:`find_spans`, and whether a start was seen before the end."""
    lists = labels.flatten().dictionary_encode()
    size = np.diff(labels.offsets.to_numpy().astype(np.int64))
    size = np.where(labels.is_null().to_numpy(zero_copy_only=False), 0, size)
    said = lists.dictionary.to_pylist() + ["O"]
    known = [_split_label(x) for x in said]
    types = sorted({t for _, t in known})
    prefix = np.array([ord(p) if p else 0 for p, _ in known], np.int64)
    kind = np.array([types.index(t) for _, t in known], np.int64)
    outside = len(known) - 1
    code = lists.indices.fill_null(outside).to_numpy(zero_copy_only=False).astype(np.int64)
    # every row gets a sentinel outside tag behind its last token
    row = np.repeat(np.arange(len(size)), size + 1)
    first = np.cumsum(size + 1) - (size + 1)
    at = np.arange(len(row)) - first[row]
    tags = np.full(len(row), outside)
    tags[at < size[row]] = code
    tag, typ = prefix[tags], kind[tags]
    before = np.concatenate([[outside], tags[:-1]])
    before[at == 0] = outside
    was, had = prefix[before], kind[before]

    def one_of(x, letters):
        return np.isin(x, [ord(c) for c in letters])
    changed = had != typ
    ends = one_of(was, "ES") | (one_of(was, "BI") & one_of(tag, "BSO")) | (~one_of(was, "O.") & changed)
    begins = one_of(tag, "BS") | (one_of(was, "ESO") & one_of(tag, "EI")) | (~one_of(tag, "O.") & changed)
    where = np.arange(len(row))
    latest = np.maximum.accumulate(np.where(begins, where, -1)) if len(row) else where
    latest = np.concatenate([[-1], latest[:-1]])
    last = np.flatnonzero(ends)
    start = np.maximum(latest[last], first[row[last]])
    seen = latest[last] >= first[row[last]]
    if mode == STRICT:
        opens, goes_on = (np.array([x == f"{letter}-{t}" for x, (_, t) in zip(said, known)])[tags] for letter in "BI")
        inside = np.concatenate([[0], np.cumsum(goes_on)])
        ok = opens[start] & (typ[start] == had[last]) & (inside[last] - inside[start + 1] == last - 1 - start)
        last, start, seen = last[ok], start[ok], seen[ok]
    return row[last], had[last], at[start], at[last] - 1, types, seen


def array_spans(labels, mode: str = CONLL):
    """``array<struct<span_type,start,end>>`` of a label array: a column of a
    column, an Arrow array of an Arrow array."""
    def of(column: pa.Array) -> pa.Array:
        row, kind, start, end, types = find_spans(column, mode)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))])
        names = pa.array(types, pa.string()).take(pa.array(kind))
        items = pa.StructArray.from_arrays([names, pa.array(start), pa.array(end)], ["span_type", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)
    if isinstance(labels, pa.Array):
        return of(labels)
    of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(of, "array<struct<span_type:string,start:long,end:long>>")(labels)


def _placed_spans(tokens: DataFrame, keys: list[str], pos_col: str, label_col: str, mode: str) -> DataFrame:
    """Spans of label arrays, a row each, by the positions of their tokens as the
    windows of :func:`spans` number them: 0 where no start was seen, and the end is
    one before the next token."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, kind, start, end, types, seen = _found(batch[label_col], mode)
        (offsets, place) = flat(batch[pos_col])
        place = np.append(place.to_numpy(zero_copy_only=False).astype(np.int64), 0)
        after = offsets[row] + end + 1
        stop = np.where(after < offsets[row + 1], place[after] - 1, place[after - 1])
        begin = np.where(seen, place[offsets[row] + start], 0)
        return rebuilt(batch.select(keys).take(pa.array(row)), [], span_type=pa.array(types, pa.string()).take(pa.array(kind)),
                       start=pa.array(begin), end=pa.array(stop))
    return passed(tokens, of, changed(T.StructType([tokens.schema[k] for k in keys]), [], span_type=STRING, start=LONG, end=LONG))


def _span_counts(groups: int, mode: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [find_spans(batch.column(groups + i), mode) for i in (0, 1)]
        width = 1 + max((int(s[3].max(initial=0)) for s in sides))
        keys = [s[0] * width + s[3] for s in sides]          # a side has one span at most that ends here
        _, g, p = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        gold, pred = sides
        names = [np.array(s[4], dtype=object) for s in sides]
        hit = g[(names[0][gold[1][g]] == names[1][pred[1][p]]) & (gold[2][g] == pred[2][p])]
        by = [[c.as_py() for c in batch.column(i)] for i in range(groups)]
        group = list(zip(*by)) if groups else [()] * len(batch)
        order = {k: i for i, k in enumerate(dict.fromkeys(group))}
        at = np.array([order[k] for k in group])
        counts = [np.bincount(at[rows], minlength=len(order)) for rows in (gold[0], pred[0], gold[0][hit])]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in order], batch.schema.field(i).type) for i in range(groups)] + [pa.array(c.astype(np.int64)) for c in counts],
            names=[batch.schema.field(i).name for i in range(groups)] + ["n_gold", "n_pred", "tp"])
    return run


def span_counts(df: DataFrame, gold: str, pred: str, by: list[str] | None = None, mode: str = CONLL) -> DataFrame:
    """``by + (n_gold, n_pred, tp)`` over rows with a gold and a predicted label
    array per sentence; a group without a span has zeros."""
    by = list(by or [])
    kinds = changed(T.StructType([df.schema[c] for c in by]), [], n_gold=LONG, n_pred=LONG, tp=LONG)
    part = passed(only(df, [*by, gold, pred]), _span_counts(len(by), mode), kinds)
    return part.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_gold", "n_pred", "tp")])


def prf(counts: DataFrame) -> DataFrame:
    """Adds ``precision``, ``recall`` and ``f1``; 0/0 counts as 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = counts.withColumn("precision", share("tp", "n_pred")).withColumn("recall", share("tp", "n_gold"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def _prefix_type(label):
    rest = F.substring(label, 2, 1 << 30)
    pos = F.instr(rest, "-")
    t = F.when(pos > 0, F.substring(rest, pos + 1, 1 << 30)).otherwise(rest)
    return F.substring(label, 1, 1), F.when(t == "", F.lit("_")).otherwise(t)


def spans(tokens: DataFrame, sent_keys: list[str], pos_col: str = "pos", label_col: str = "label",
          mode: str = "conll") -> DataFrame:
    """``sent_keys + (span_type, start, end)`` (inclusive token positions).

    ``mode='strict_bio'`` keeps only spans that open with ``B``; tags other than
    ``B``, ``I`` and ``O`` are for :func:`find_spans`. A row with arrays of
    positions and labels is a whole sentence, and its spans are found in place."""
    if is_array(tokens, label_col):
        return _placed_spans(tokens, sent_keys, pos_col, label_col, mode)
    base = tokens.select(*sent_keys, F.col(pos_col).cast("long").alias("pos"), F.col(label_col).alias("label"))
    sentinel = base.groupBy(*sent_keys).agg((F.max("pos") + 1).alias("pos")).withColumn("label", F.lit("O"))
    t = base.unionByName(sentinel)
    tag, typ = _prefix_type(F.col("label"))
    t = t.withColumn("tag", tag).withColumn("typ", typ)
    w = Window.partitionBy(*sent_keys).orderBy("pos")
    pt = F.lag("tag", 1, "O").over(w)
    py = F.lag("typ", 1, "_").over(w)
    t = t.withColumn("ptag", pt).withColumn("ptyp", py)
    tg, pg, ty, pty = F.col("tag"), F.col("ptag"), F.col("typ"), F.col("ptyp")
    end = ((pg == "E") | (pg == "S")
           | (pg.isin("B", "I") & tg.isin("B", "S", "O"))
           | ((pg != "O") & (pg != ".") & (pty != ty)))
    start = (tg.isin("B", "S")
             | (pg.isin("E", "S", "O") & tg.isin("E", "I"))
             | ((tg != "O") & (tg != ".") & (pty != ty)))
    t = t.withColumn("is_end", end).withColumn("is_start", start)
    wprev = w.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.max(F.when(F.col("is_start"), F.col("pos"))).over(wprev), F.lit(0).cast("long"))
    t = t.withColumn("begin", begin)
    out = t.filter("is_end").select(*sent_keys, F.col("ptyp").alias("span_type"),
                                    F.col("begin").alias("start"), (F.col("pos") - 1).alias("end"))
    if mode == "strict_bio":
        lab = base.select(*sent_keys, "pos", "label")
        first = lab.withColumnRenamed("pos", "start").withColumnRenamed("label", "first_label")
        out = out.join(first, on=sent_keys + ["start"]).filter(
            F.col("first_label") == F.concat(F.lit("B-"), F.col("span_type"))).drop("first_label")
    return out


def span_prf(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Micro precision / recall / F1 over exact span matches
    ``keys + (span_type, start, end)``; 0/0 counts as 0."""
    by = list(by or [])
    k = keys + ["span_type", "start", "end"]
    g = gold.select(*k).withColumn("g", F.lit(1))
    p = pred.select(*k).withColumn("p", F.lit(1))
    j = g.join(p, on=k, how="full_outer")
    agg = j.groupBy(*by).agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"),
                             F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"))
    return prf(agg)
