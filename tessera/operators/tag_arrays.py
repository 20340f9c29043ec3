"""Tag files kept a file (or document) per row, with parallel arrays of lines.

A document that is read as one row has its lines in order already; no window
over its tokens and no regrouping is needed. The functions here are the array
forms of the operators in :mod:`tessera.operators.tagging` and
:mod:`tessera.operators.fragments`, which choose them by column type: each is
one pass over the flat arrays of some rows, and rows stay where they are.

Passes that follow one another run in one Python worker (:func:`passed`), on
slices of an Arrow batch of bounded bytes. A task so holds one worker and the
lines of a slice (or of one longer row), not a worker and the lines of a whole
batch for every pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 20          # bytes of rows that a pass takes at a time

INT, LONG, STRING = T.IntegerType(), T.LongType(), T.StringType()
BOOLEANS, INTS, LONGS, STRINGS = (T.ArrayType(t) for t in (T.BooleanType(), INT, LONG, STRING))


def is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of ``most`` bytes or of one row."""
    if len(batch) < 2 or batch.nbytes <= most:
        yield batch
        return
    half = len(batch) // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def _passes(steps: tuple):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for step in steps:
                    if not len(part):
                        break
                    part = step(part)
                else:
                    if len(part):
                        yield part
    return run


def passed(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``step`` over the rows of ``df``, which looks at one row at a time. A
    frame that is itself the result of a pass is not run on its own: its steps and
    this one follow one another in the same worker."""
    source, steps = df.__dict__.get("_passed", (df, ()))
    steps = (*steps, step)
    out = source.mapInArrow(_passes(steps), schema)
    out.__dict__["_passed"] = (source, steps)
    return out


def changed(schema: T.StructType, without: list[str], **added: T.DataType) -> T.StructType:
    """``schema`` without some columns and with ``added`` ones behind the others."""
    return T.StructType([f for f in schema.fields if f.name not in without and f.name not in added]
                        + [T.StructField(n, t) for n, t in added.items()])


def rebuilt(batch: pa.RecordBatch, without: list[str], **added: pa.Array) -> pa.RecordBatch:
    """The columns of :func:`changed`."""
    cols = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in without and n not in added} | added
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def only(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns ``cols``: a pass behind others, or a selection."""
    if "_passed" not in df.__dict__:
        return df.select(*cols)
    return passed(df, lambda batch: batch.select(cols), T.StructType([df.schema[c] for c in cols]))


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the values of a list array; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)]), lists.flatten()


def lists(offsets: np.ndarray, values: pa.Array, like: pa.Array | None = None) -> pa.Array:
    mask = None if like is None or not like.null_count else pa.array(np.append(like.is_null().to_numpy(zero_copy_only=False), False))
    at = offsets.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at) if mask is None else pa.array(at, mask=mask.to_numpy(zero_copy_only=False)), values)


def _row(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def tag_fields(lines: DataFrame, default_label: str) -> DataFrame:
    """:func:`tagging.read_tagged` for arrays of lines."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, lines = flat(batch["text"])
        lines = pc.utf8_trim_whitespace(pc.fill_null(lines, ""))
        blank = pc.equal(lines, "")
        items = pc.utf8_split_whitespace(lines)
        at, values = items.offsets.to_numpy().astype(np.int64), items.values
        n = np.where(blank.to_numpy(zero_copy_only=False), 0, np.diff(at))
        two = n == 2
        token = pc.if_else(blank, pa.scalar(None, pa.string()), values.take(pa.array(at[:-1])))
        label = pc.if_else(pa.array(two), values.take(pa.array(at[:-1] + two)), default_label)
        label = pc.if_else(blank, pa.scalar(None, pa.string()), label)
        return rebuilt(batch, ["text"], is_blank=lists(offsets, blank), n_fields=lists(offsets, pa.array(n.astype(np.int32))),
                       token=lists(offsets, token), label=lists(offsets, label))
    return passed(lines, of, changed(lines.schema, ["text"], is_blank=BOOLEANS, n_fields=INTS, token=STRINGS, label=STRINGS))


def blanks_before(df: DataFrame, blank: str, out: str) -> DataFrame:
    """Adds the number of blank lines before each line of its row."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, values = flat(batch[blank])
        one = values.to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(one)])
        return rebuilt(batch, [], **{out: lists(offsets, pa.array(before[:-1] - np.repeat(before[offsets[:-1]], np.diff(offsets))))})
    return passed(df, of, changed(df.schema, [], **{out: LONGS}))


def drop_lines(df: DataFrame, dropped: str, cols: list[str], order: str) -> DataFrame:
    """The array columns ``cols`` without the lines that the boolean array
    ``dropped`` marks; ``order`` gets the numbers of the lines that stay."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, mark = flat(batch[dropped])
        stay = np.flatnonzero(~mark.to_numpy(zero_copy_only=False).astype(bool))
        ends = np.searchsorted(stay, offsets)
        at = stay - offsets[:-1][_row(offsets)[stay]]
        kept = {c: lists(ends, flat(batch[c])[1].take(pa.array(stay))) for c in cols}
        return rebuilt(batch, [dropped], **kept, **{order: lists(ends, pa.array(at))})
    return passed(df, of, changed(df.schema, [dropped], **{c: df.schema[c].dataType for c in cols}, **{order: LONGS}))


def _pieces(words: pa.Array, piece_len: int, unk: str) -> np.ndarray:
    n = pc.fill_null(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = -(-n // piece_len)
    n[pc.fill_null(pc.equal(words, unk), False).to_numpy(zero_copy_only=False)] = 1
    return n


def unk_arrays(df: DataFrame, token: str, budget: int, piece_len: int, unk: str, original: str | None) -> DataFrame:
    """:func:`tagging.unk_tokens` for arrays of tokens."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, words = flat(batch[token])
        n = _pieces(words, piece_len, unk)
        bad = n > budget
        mark = pa.array(bad)
        cols = {token: pc.if_else(mark, unk, words), "n_pieces": pa.array(np.where(bad, 1, n).astype(np.int32))}
        if original:
            cols[original] = pc.if_else(mark, words, pa.scalar(None, pa.string()))
        return rebuilt(batch, [], **{c: lists(offsets, v) for c, v in cols.items()})
    return passed(df, of, changed(df.schema, [], **{token: STRINGS, "n_pieces": INTS}, **({original: STRINGS} if original else {})))


def _runs(offsets: np.ndarray, keys: list[pa.Array]) -> np.ndarray:
    """Where a row begins or a key changes, and the end."""
    first = np.zeros(offsets[-1], bool)
    first[offsets[:-1][offsets[:-1] < offsets[-1]]] = True
    for k in keys:
        v = k.to_numpy(zero_copy_only=False)
        first[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(first), offsets[-1])


def pack_arrays(df: DataFrame, cols: list[str], keys: list[str], n_col: str, budget: int, positions: Callable) -> DataFrame:
    """The columns ``cols``, and ``frag`` and ``pos`` of every token; sentences
    are runs of equal ``keys``."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, n = flat(batch[n_col])
        runs = _runs(offsets, [flat(batch[k])[1] for k in keys])
        none = np.zeros(len(runs) - 1, np.int64)
        packed = positions(lists(runs, n), none, none, none, budget).values
        return rebuilt(batch.select(cols), [], **{c: lists(offsets, packed.field(i)) for i, c in enumerate(("frag", "pos"))})
    return passed(df, of, changed(T.StructType([df.schema[c] for c in cols]), [], frag=INTS, pos=INTS))


def run_rows(df: DataFrame, keys: list[str], cols: dict[str, str], number: str | None = None) -> DataFrame:
    """A row per run of equal ``keys`` (those that are arrays) with the arrays
    ``cols`` of its lines; ``number`` is the run's 1-based number in its row."""
    runs = [k for k in keys if is_array(df, k)]
    schema = T.StructType([T.StructField(k, df.schema[k].dataType.elementType) if k in runs else df.schema[k] for k in keys])

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets = flat(batch[[*runs, *cols.values()][0]])[0]
        starts = {k: flat(batch[k])[1] for k in runs}
        at = _runs(offsets, list(starts.values()))
        begin = at[:-1]
        row = _row(offsets)[begin]
        out = {k: starts[k].take(pa.array(begin)) if k in runs else batch[k].take(pa.array(row)) for k in keys}
        out |= {o: lists(at, flat(batch[c])[1]) for o, c in cols.items()}
        if number:
            out[number] = pa.array((np.arange(len(begin)) - np.searchsorted(begin, offsets[:-1])[row] + 1).astype(np.int32))
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return passed(df, of, changed(schema, [], **{o: df.schema[c].dataType for o, c in cols.items()}, **({number: INT} if number else {})))


def token_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """The parallel arrays ``cols`` as rows, a token each."""
    rest = [c for c in df.columns if c not in cols]
    schema = T.StructType([df.schema[c] for c in rest])

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [flat(batch[c]) for c in cols]
        if any(not np.array_equal(at, each[0][0]) for at, _ in each):
            raise ValueError("the arrays of a row differ in length")
        row = pa.array(_row(each[0][0]))
        return pa.RecordBatch.from_arrays([batch[c].take(row) for c in rest] + [v for _, v in each], rest + cols)
    return passed(df, of, changed(schema, [], **{c: df.schema[c].dataType.elementType for c in cols}))


def aligned_pieces(words: pa.Array, label_ids: pa.Array, piece_len: int, unk: str, ignore: int) -> pa.Array:
    """The labels of :func:`tagging.align_labels`."""
    offsets, w = flat(words)
    n = np.maximum(_pieces(w, piece_len, unk), 1)
    ends = np.concatenate([[0], np.cumsum(n)])
    index = np.full(ends[-1], len(w), np.int64)
    index[ends[:-1]] = np.arange(len(w))
    labels = pa.concat_arrays([flat(label_ids)[1].cast(pa.int32()), pa.array([ignore], pa.int32())])
    return lists(ends[offsets], labels.take(pa.array(index)), words)


def cut_labels(labels: pa.Array, max_len: int, special: int, ignore: int) -> pa.Array:
    """The labels of :func:`tagging.feature_labels`."""
    offsets, values = flat(labels)
    n = np.minimum(np.diff(offsets), max_len - special)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    out = np.full((len(n), max_len), ignore, np.int32)
    out[row, 1 + place] = values.to_numpy(zero_copy_only=False)[offsets[:-1][row] + place]
    return lists(np.arange(len(n) + 1) * max_len, pa.array(out.reshape(-1)), labels)


def scored(pred: pa.Array, gold: pa.Array, names: dict[int, str], ignore: int) -> tuple[pa.Array, pa.Array]:
    """Names of gold and predicted ids at the positions whose gold id is not
    ignored."""
    (offsets, g), (at, p) = flat(gold), flat(pred)
    stay = np.flatnonzero(g.to_numpy(zero_copy_only=False) != ignore)
    row = _row(offsets)[stay]
    place = stay - offsets[:-1][row]
    there = place < np.diff(at)[row]
    of_pred = p.take(pa.array(np.where(there, at[:-1][row] + place, 0), mask=~there))
    ends, ids, known = np.searchsorted(stay, offsets), pa.array(list(names), pa.int32()), pa.array(list(names.values()), pa.string())
    return tuple(lists(ends, known.take(pc.index_in(x.cast(pa.int32()), ids))) for x in (g.take(pa.array(stay)), of_pred))


def written(df: DataFrame, cols: list[str]) -> DataFrame:
    """String arrays as strings, an element a line (a null is ``\\N``): what moves
    in a shuffle is then little more than the letters."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {}
        for c in cols:
            offsets, v = flat(batch[c])
            v = pc.replace_substring(pc.replace_substring(v, "\\", "\\\\"), "\n", "\\n")
            v = pc.binary_join_element_wise(pc.fill_null(v, "\\N"), "", "\n")
            text = pc.binary_join(lists(offsets, v), "")
            out[c] = pc.if_else(batch[c].is_null(), pa.scalar(None, pa.string()), text)
        return rebuilt(batch, [], **out)
    return passed(df, of, changed(df.schema, [], **{c: STRING for c in cols}))


def spelled(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and elements of the arrays that :func:`written` wrote; null gives none."""
    offsets, v = flat(pc.split_pattern(pc.fill_null(text, ""), "\n"))
    last = np.zeros(len(v), bool)
    last[offsets[1:] - 1] = True                    # what stands behind the last line end
    offsets, v = offsets - np.arange(len(offsets)), v.filter(pa.array(~last))
    null = pc.equal(v, "\\N")
    if pc.any(pc.match_substring(v, "\\")).as_py():
        v = pc.replace_substring(pc.replace_substring(pc.replace_substring(v, "\\\\", "\0"), "\\n", "\n"), "\0", "\\") \
            if not pc.any(pc.match_substring(v, "\0")).as_py() else pa.array([_unescaped(x) for x in v.to_pylist()], pa.string())
        v = pc.if_else(null, pa.scalar(None, pa.string()), v)
    return offsets, v


def _unescaped(x: str) -> str:
    return "\\".join(part.replace("\\n", "\n") for part in x.split("\\\\"))


def zipped(df: DataFrame, keys: list[str], frags: str) -> DataFrame:
    """``tokens`` and ``preds`` of a sentence from its fragments in order, each
    with what was :func:`written` of both: a token without a prediction gets null,
    predictions beyond the tokens are dropped."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, f = flat(batch[frags])
        (ends, tokens), (at, preds) = (spelled(f.field(i)) for i in (1, 2))
        row = _row(ends)
        place = np.arange(len(row)) - ends[:-1][row]
        there = place < np.diff(at)[row]
        preds = preds.take(pa.array(np.where(there, at[:-1][row] + place, 0), mask=~there))
        return rebuilt(batch.select(keys), [], tokens=lists(ends[offsets], tokens), preds=lists(ends[offsets], preds))
    return passed(df, of, changed(T.StructType([df.schema[k] for k in keys]), [], tokens=STRINGS, preds=STRINGS))
