"""Sub-word tokens by longest match against a vocabulary table.

The vocabulary stays a table: nothing is collected, limited or switched by its
size. Text is encoded by distinct words:

1. :func:`longest_match` works once per distinct word of the corpus. A word
   gets the word-start mark. A slice of words is a chunk with its distinct
   substrings up to the longest piece; these are joined with the pieces, and one
   linear walk per word goes from the end of the longest piece that starts at a
   position to the start of the next. Characters that no piece covers give one unknown id per run.
2. :func:`encode_by_words` replaces the words of a text (or word array) column
   by ids that a function gives per distinct word (or per distinct piece of a
   word). The column is read once: a slice of an Arrow batch becomes one row, a
   chunk, with its rows as a compressed block, in which words are numbers, and its
   distinct words. Only these are given ids and joined back (a frequent word is one
   row per chunk, so it makes no hot key); the block meets its own part of the
   dictionary by one join of the chunks.

:func:`piece_ids` is the function for the rule of fixed-length pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tag_arrays import INTS, flat, lists, passed, slices
from tessera.operators.vocab import UNK, UNK_ID, WORD_START
from tessera.session import stage_table

CHUNK = 4 << 20          # bytes of rows in a chunk


def _substrings(longest: int):
    """Words to chunks with the distinct substrings that a piece could be."""
    def run(batches):
        base, k = TaskContext.get().partitionId() << 33, 0
        for part in (p for batch in batches for p in slices(batch)):
            if len(part):
                found = set()
                for word in part["word"].to_pylist():
                    marked = WORD_START + word
                    for at in range(len(marked)):
                        found.update(marked[at:at + n] for n in range(1, longest + 1))
                yield _chunk_row(base + k, part, pa.array(list(found), pa.string()))
                k += 1
    return run


def _walked(longest: int, unk_id: int):
    """Greedy walk over the longest pieces by start position."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, out = [], []
        for block, known in zip(batch["rows"], batch["known"]):
            pieces = {x["word"]: x["ids"][0] for x in known.as_py() or ()}
            for word in next(iter(pa.ipc.open_stream(block.as_buffer())))["word"].to_pylist():
                words.append(word)
                out.append([unk_id] if word == UNK else one(WORD_START + word, pieces))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(out, pa.list_(pa.int32()))], ["word", "ids"])

    def one(marked: str, pieces: dict[str, int]) -> list[int]:
        at, ids, open_gap = 0, [], False
        while at < len(marked):
            for n in range(min(longest, len(marked) - at), 0, -1):
                piece = pieces.get(marked[at:at + n])
                if piece is not None:
                    break
            else:
                n, piece = 1, unk_id
            if piece != unk_id or not open_gap:
                ids.append(piece)
            open_gap = piece == unk_id
            at += n
        return ids
    return of


def longest_match(words: DataFrame, vocab: DataFrame, unk_id: int = UNK_ID) -> DataFrame:
    """``(word, ids)`` for the distinct, non-empty words of ``words``.

    ``vocab`` is ``(piece, piece_id, is_special)``; special pieces never match
    inside a word, but the unknown token as a word is its own id. A word-start
    mark that only an unknown run follows belongs to that run."""
    words = words.select("word").distinct()
    pieces = vocab.filter(~F.col("is_special")).select("piece", "piece_id")
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    chunks = stage_table(words.mapInArrow(_substrings(longest), "chunk long, rows binary, units array<string>"), "match-chunks")
    return passed(_met(chunks, lambda units: piece_ids(units, pieces)), _walked(longest, unk_id),
                  T.StructType([T.StructField("word", T.StringType()), T.StructField("ids", INTS)]))


class _Chunks:
    """Rows to chunks: ``chunk``, its ``rows`` (all columns; the encoded ones as
    numbers of units, word arrays that stay by their dictionary, from which the
    numbers follow again) and its distinct ``units``: words, or what ``cut`` makes of
    a word."""

    def __init__(self, keep: list[str], again: list[str], cols: dict[str, str], cut: Callable | None):
        self.keep, self.again, self.cols, self.cut = keep, again, cols, cut

    def __call__(self, batches):
        base, k = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in slices(batch, CHUNK):
                if len(part):
                    yield self.chunk(part, base + k)
                    k += 1

    def chunk(self, part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        split = {o: part[c] if pa.types.is_list(part[c].type) else pa.array([None if t is None else t.split() for t in part[c].to_pylist()], pa.list_(pa.string()))
                 for o, c in self.cols.items()}
        ends = {o: flat(w)[0] for o, w in split.items()}
        words = pa.concat_arrays([w.flatten() for w in split.values()]).dictionary_encode()
        index, units = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        if self.cut:
            many, pieces = flat(self.cut(units))
            pieces = pieces.dictionary_encode()
            index, before = expanded(index, many, pieces.indices.to_numpy(zero_copy_only=False))
            units = pieces.dictionary
        else:
            before = np.arange(len(index) + 1)
        index = index.astype(np.uint16 if len(units) <= 1 << 16 else np.int32)
        out, at, sides = {c: part[c] for c in self.keep}, 0, {}
        for o, w in split.items():
            rows = before[at + ends[o]]
            if self.cols[o] in self.again:
                out[self.cols[o]] = lists(ends[o], words.slice(at, ends[o][-1]), w)
            else:
                sides[o] = rows - rows[0], index[rows[0]:rows[-1]]
                out[o] = pa.array(np.diff(rows), mask=w.is_null().to_numpy(zero_copy_only=False))
            at += ends[o][-1]
        if sides:
            out[UNITS] = _beside(list(sides.values()))
        return _chunk_row(number, pa.RecordBatch.from_arrays(list(out.values()), list(out)), units)


UNITS = "__units"


def _chunk_row(number: int, rows: pa.RecordBatch, units: pa.Array) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(rows)
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), lists(np.array([0, len(units)]), units)],
                                      ["chunk", "rows", "units"])


def _places(sizes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row ends, and where the elements of each side are, if a row has its elements
    of one side behind those of the other."""
    ends = np.concatenate([[0], np.cumsum(sum(sizes))])
    out, start = [], ends[:-1]
    for n in sizes:
        first = np.cumsum(n) - n
        out.append(np.repeat(start - first, n) + np.arange(n.sum()))
        start = start + n
    return ends, out


def _beside(sides: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """The sides of a row next to one another: they often share words, which then
    pack well."""
    ends, places = _places([np.diff(e) for e, _ in sides])
    values = np.empty(ends[-1], sides[0][1].dtype)
    for at, (_, v) in zip(places, sides):
        values[at] = v
    return lists(ends, pa.array(values))


def expanded(index: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists that ``index`` names, one list behind the other
    (list ``i`` is ``values[ends[i]:ends[i + 1]]``), and the offsets of the result."""
    size = np.diff(ends)[index]
    before = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(ends[:-1][index] - before[:-1], size) + np.arange(before[-1])], before


def _numbers(rows: pa.RecordBatch, cols: dict[str, str], cut: Callable | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Offsets and numbers of units of the encoded columns of a chunk. All word
    arrays that stay have the dictionary of the whole chunk."""
    out, sides = {}, [o for o in cols if o in rows.schema.names]
    if sides:
        sizes = [rows[o].fill_null(0).to_numpy(zero_copy_only=False) for o in sides]
        values = rows[UNITS].flatten().to_numpy(zero_copy_only=False)
        for o, n, at in zip(sides, sizes, _places(sizes)[1]):
            out[o] = np.concatenate([[0], np.cumsum(n)]), values[at].astype(np.int64)
    for o in (o for o in cols if o not in sides):
        ends, values = flat(rows[cols[o]])
        index = values.indices.to_numpy(zero_copy_only=False)
        if cut:
            many, pieces = flat(cut(values.dictionary))
            index, before = expanded(index, many, pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False))
            ends = before[ends]
        out[o] = ends, index
    return out


def _encoded(cols: dict[str, str], order: list[str], unk_id: int, cut: Callable | None):
    """A chunk and its part of the dictionary to rows with ids."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [one(*x) for x in zip(batch["rows"], batch["known"])]
        return done[0] if len(done) == 1 else pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    def one(block, known) -> pa.RecordBatch:
        rows = next(iter(pa.ipc.open_stream(block.as_buffer())))
        numbered = _numbers(rows, cols, cut)
        numbers = {o: v for o, (_, v) in numbered.items()}
        total = 1 + max((int(v.max(initial=-1)) for v in numbers.values()), default=-1)
        size, start, ids = np.ones(total, np.int64), np.zeros(total, np.int64), np.array([unk_id], np.int32)
        if known.is_valid and len(known.values):
            at, (ends, values) = known.values.field("at").to_numpy(), flat(known.values.field("ids"))
            ids = np.concatenate([ids, values.to_numpy(zero_copy_only=False).astype(np.int32)])
            size[at], start[at] = np.diff(ends), ends[:-1] + 1
        out = {}
        for c in order:
            if c in numbers:
                each = size[numbers[c]]
                ends = np.concatenate([[0], np.cumsum(each)])
                values = ids[np.repeat(start[numbers[c]] - ends[:-1], each) + np.arange(ends[-1])]
                out[c] = lists(ends[numbered[c][0]], pa.array(values, pa.int32()), rows[c if c in rows.schema.names else cols[c]])
            elif pa.types.is_list(rows[c].type) and pa.types.is_dictionary(rows[c].type.value_type):
                ends, values = flat(rows[c])
                out[c] = lists(ends, values.dictionary_decode(), rows[c])
            else:
                out[c] = rows[c]
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return of


def _met(chunks: DataFrame, ids_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(rows, known)`` of every chunk: its block and the units that have ids."""
    spark = chunks.sparkSession
    mine = chunks.select("chunk", F.posexplode("units").alias("at", "word"))
    # a chunk is small as it is stored and large as rows: partitions go by their number
    number = chunks.count()
    parts = max(1, min(number, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, number // 16)))
    known = mine.join(ids_of(mine.select("word").distinct()), "word").select("chunk", "at", "word", "ids").repartition(parts, "chunk") \
                .groupBy("chunk").agg(F.collect_list(F.struct("at", "ids", "word")).alias("known"))
    both = chunks.select("chunk", "rows").repartition(parts, "chunk").join(known, "chunk", "left")
    return both.select("rows", "known")


def encode_by_words(df: DataFrame, ids_of: Callable[[DataFrame], DataFrame], cols: dict[str, str], unk_id: int = UNK_ID, keep_input: bool = False,
                    cut: Callable | None = None) -> DataFrame:
    """Text columns (``cols``: output → input column) as id arrays: the ids of
    every whitespace-separated word in order, or with ``cut`` of every piece that it
    makes of a word. ``ids_of`` turns the distinct ``(word)`` (or pieces) into
    ``(word, ids)``; one that it leaves out gives the unknown id, a null input null.
    An input column of word arrays is taken as it is. Inputs are dropped unless
    ``keep_input``."""
    gone = set() if keep_input else set(cols.values())
    fields = [f for f in df.schema.fields if f.name not in gone]
    again = [c for c in dict.fromkeys(cols.values()) if keep_input and isinstance(df.schema[c].dataType, T.ArrayType)]
    out = T.StructType(fields + [T.StructField(o, INTS) for o in cols])
    chunks = stage_table(df.mapInArrow(_Chunks([f.name for f in fields if f.name not in again], again, cols, cut), "chunk long, rows binary, units array<string>"), "word-chunks")
    both = _met(chunks, ids_of)
    return passed(both, _encoded(cols, out.names, unk_id, cut), out)


def piece_ids(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, ids)`` of pieces that the vocabulary has."""
    return pieces.join(vocab.select(F.col("piece").alias("word"), F.array("piece_id").alias("ids")), "word")


def tokenize(df: DataFrame, vocab: DataFrame, cols: dict[str, str], unk_id: int = UNK_ID) -> DataFrame:
    """Text columns (``cols``: output → text column) as ids of the longest
    vocabulary pieces, left to right within every word."""
    return encode_by_words(df, lambda words: longest_match(words, vocab, unk_id), cols, unk_id)


# DuckDB twin ----------------------------------------------------------------

def sql_longest_match(words_cte: str, vocab: str = "vocab", name: str = "wid") -> str:
    """CTEs that define ``name(word, ids)``: the longest piece at every
    position, walked recursively from position 0 (``WITH RECURSIVE`` needed)."""
    return f"""
{name}_w AS (SELECT DISTINCT word, '{WORD_START}' || word AS m FROM {words_cte} WHERE word <> '' AND word <> '{UNK}'),
{name}_s AS (SELECT word, m, unnest(range(0, length(m))) AS s FROM {name}_w),
{name}_l AS (SELECT word, s, unnest(range(1, least(length(m) - s, (SELECT max(length(piece)) FROM {vocab} WHERE NOT is_special)) + 1)) AS l, m FROM {name}_s),
{name}_b AS MATERIALIZED (
  SELECT word, s, max(l) AS l, arg_max(piece_id, l) AS id FROM {name}_l JOIN {vocab} ON piece = substr(m, s + 1, l) AND NOT is_special GROUP BY word, s),
{name}_r(word, size, done, ids) AS (
  SELECT word, length(m), 0::BIGINT, []::INTEGER[] FROM {name}_w
  UNION ALL
  SELECT r.word, size, done + coalesce(l, 1), CASE WHEN b.id IS NULL AND ids[-1] = {UNK_ID} THEN ids ELSE list_append(ids, coalesce(b.id, {UNK_ID})) END
  FROM {name}_r r LEFT JOIN {name}_b b ON b.word = r.word AND b.s = r.done WHERE done < size),
{name} AS (SELECT word, ids FROM {name}_r WHERE done >= size UNION ALL SELECT '{UNK}', [{UNK_ID}]::INTEGER[])"""
