"""Word and letter n-gram counts per class of a bounded labelled sample
(shared by the two trained operators). Words and n-grams are counted on Spark;
all of those in the sampled rows reach the driver, however rare."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.ngrams import Letters, slices, split_words

BLOCK = 1 << 16         # words whose n-grams a task counts at once


def class_word_counts(texts: DataFrame, by: str) -> DataFrame:
    """``texts`` has ``text`` and ``by``. Returns ``class, word, n`` of every
    word, as a written table."""
    pairs = texts.select(F.col(by).alias("class"), F.coalesce("text", F.lit("")).alias("text"))
    kind = pairs.schema["class"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            classes = batch.column(0).dictionary_encode()
            of = classes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for start, part in slices(batch.column(1)):
                offsets, index, words = split_words(part)
                if not len(words):
                    continue
                cls = np.repeat(of[start:start + len(part)], np.diff(offsets))
                keys, n = np.unique(cls * len(words) + index, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [classes.dictionary.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), pa.array(n)],
                    ["class", "word", "n"])

    return stage(pairs.mapInArrow(count, f"class {kind}, word string, n long")
                 .filter(F.col("word") != "").groupBy("class", "word").agg(F.sum("n").alias("n")), "words")


def class_ngrams(counts: DataFrame, top: int):
    """``(classes, orders)`` of ``class_word_counts``: the classes in ascending
    order, and for each order 1..``top`` the sorted hashes ``keys`` of all
    n-grams, their count matrix ``raw`` (n-grams x classes), whether each
    ``begins`` a word, and the n-grams of the order below without the first
    (``tail``) and the last letter (``head``)."""
    kind = counts.schema["class"].dataType.simpleString()
    names = ["class", "k", "gram", "tail", "head", "begins", "n"]

    def grams_of(rows: pa.Table):
        classes = rows.column("class").combine_chunks().dictionary_encode()
        of_class = classes.indices.to_numpy(zero_copy_only=False)
        for c in range(len(classes.dictionary)):
            mine = rows.take(pa.array(np.flatnonzero(of_class == c)))
            letters = Letters(mine.column("word").combine_chunks())
            n = np.repeat(mine.column("n").to_numpy(), np.diff(letters.starts))
            below = np.zeros(len(n), np.uint64)
            for k, grams in enumerate(letters.ngrams(top), 1):
                ok = np.flatnonzero(letters.inside >= max(1, k - 1))
                keys, first, inv = np.unique(grams[ok], return_index=True, return_inverse=True)
                at = ok[first]
                yield pa.RecordBatch.from_arrays(
                    [classes.dictionary.take(pa.array(np.full(len(keys), c))), pa.array(np.full(len(keys), k, np.int32)),
                     *(pa.array(x.view(np.int64)) for x in (keys, below[at], below[at - 1])), pa.array(letters.inside[at] == k - 1),
                     pa.array(np.bincount(inv, weights=n[ok], minlength=len(keys)).astype(np.int64))], names)
                below = grams

    def count(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= BLOCK:
                yield from grams_of(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if size:
            yield from grams_of(pa.Table.from_batches(waiting))

    rows = counts.mapInArrow(count, f"class {kind}, k int, gram long, tail long, head long, begins boolean, n long") \
        .groupBy("class", "k", "gram").agg(*[F.first(c).alias(c) for c in names[3:6]], F.sum("n").alias("n")).toArrow()
    classes, of_class = _classes(rows)
    order = rows.column("k").to_numpy()
    cols = {c: rows.column(c).to_numpy() for c in names[2:]}
    orders = []
    for k in range(1, top + 1):
        at = np.flatnonzero(order == k)
        keys, first, inv = np.unique(cols["gram"][at].view(np.uint64), return_index=True, return_inverse=True)
        raw = np.zeros((len(keys), len(classes)))
        raw[inv, of_class[at]] = cols["n"][at]
        one = at[first]
        orders.append({"keys": keys, "raw": raw, "begins": cols["begins"][one].astype(bool),
                       "tail": cols["tail"][one].view(np.uint64), "head": cols["head"][one].view(np.uint64)})
    return classes, orders


def class_words(counts: DataFrame, classes: list):
    """All words of ``class_word_counts`` (an Arrow string array) and their
    count matrix, words x ``classes``."""
    rows = counts.toArrow()
    _, of_class = _classes(rows)
    words = rows.column("word").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(words.dictionary), len(classes)))
    matrix[words.indices.to_numpy(zero_copy_only=False), of_class] = rows.column("n").to_numpy()
    return words.dictionary, matrix


def _classes(rows: pa.Table):
    """The classes in ascending order and each row's place among them."""
    found = rows.column("class").combine_chunks().dictionary_encode()
    names = found.dictionary.to_pylist()
    classes = sorted(names)
    rank = {c: i for i, c in enumerate(classes)}
    return classes, np.array([rank[c] for c in names], dtype=np.int64)[found.indices.to_numpy(zero_copy_only=False)]
