"""Operator 13, spelling variant grouping: bidirectional FM-index search schemes.

Words are counted over all documents (every task sums what it reads before the
shuffle). The vocabulary is dealt into parts of bounded size by word length
and hash. A part is one delimited text ``#w1#w2#...`` with two FM-indexes, one
of the text and one of its reverse; a pattern is a pair of suffix-rank
intervals that both grow by a letter on the left or on the right. One edit
leaves one half of a word untouched, so the search scheme has two searches:
the left half is matched exactly, outward to the delimiter on its left, and
extended over the right half with exactly one error; or the right half is
matched exactly, outward to the delimiter on its right, and extended over the
left half. Every word is looked up in all parts of its own length and of the
lengths next to it, in blocks of bounded size; near words are reduced to a
count and the best one before they leave the task.

``forms`` of words have at least twice their count, so chains are shorter than
40 steps and pointer doubling follows them to the end in a few joins.

Defined cases: null and empty texts have no word; a null id counts as the
empty text in the draw that edits a run; repeated rows count again; the letter
range holds U+00D7 and U+00F7 as the contract writes it; ties of the form go
to the smallest word in code-point order; words of ``LONGEST`` letters or more
share parts; other columns, whatever their names, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ONE_IN = 97                 # a run is edited where this divides its draw
LEAST_LETTERS, LEAST_COUNT = 5, 3
LONGEST = 64                # words this long or longer share parts
PART_LETTERS = 1 << 18      # letters of one indexed part
BLOCK = 1 << 15             # words looked up by one task in one part
HELD = 200_000              # distinct words that a task sums before it hands them on


# --- words ------------------------------------------------------------------

def _counted(letters: int):
    def run(batches):
        held = Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(texts)):
                text = texts[i].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if ids[i].as_py() is None else ids[i].as_py()}:".encode())
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) < letters:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % ONE_IN == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1:]
                        if len(word) < letters:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield _sums(held)
                    held = Counter()
        if held:
            yield _sums(held)
    return run


def _sums(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of every word with at least ``letters`` code points and
    ``least`` occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(_counted(letters), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- the index --------------------------------------------------------------

def _rotations(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of the sorted rotations (prefix doubling, eight symbols
    packed into the first key)."""
    size, width = len(text), max(1, int(62 / np.log2(symbols + 1)))
    key = np.zeros(size, np.int64)
    for i in range(width):
        key = key * symbols + np.roll(text, -i)
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.zeros(size, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == size - 1 or width >= size:
            return order
        key = rank * size + np.roll(rank, -width)
        width *= 2


class Ranks:
    """FM-index of a cyclic text: ``step[i, c]`` is the rank, among all
    rotations, of the first rotation ``c + r`` with ``r`` at rank ``i`` or later."""

    def __init__(self, text: np.ndarray, symbols: int):
        size = len(text)
        self.order = _rotations(text, symbols)
        seen = np.zeros((size + 1, symbols), np.int32)
        seen[np.arange(1, size + 1), text[self.order - 1]] = 1
        np.cumsum(seen, axis=0, out=seen)
        before = np.concatenate([[0], np.cumsum(seen[-1])[:-1]]).astype(np.int32)
        self.step = seen + before


class Vocabulary:
    """Distinct words as one delimited text with both indexes."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), dtype=np.uint32)
        self.letters = np.unique(np.concatenate([np.zeros(1, np.uint32), codes]))
        text = np.searchsorted(self.letters, codes)
        size, starts = len(text), np.flatnonzero(text == 0)
        self.size = size
        self.sides = [Ranks(text, len(self.letters)), Ranks(text[::-1].copy(), len(self.letters))]
        # the word that a match from delimiter to delimiter stands for, by its first position in each text
        owner = [np.full(size, -1, np.int64), np.full(size, -1, np.int64)]
        owner[0][starts] = np.arange(len(starts))
        owner[1][size - 1 - starts] = np.arange(len(starts)) - 1
        owner[1][size - 1 - starts[0]] = len(starts) - 1
        self.owner = [owner[k][self.sides[k].order] for k in (0, 1)]

    def symbols(self, words: list[str]) -> np.ndarray:
        """A row of symbols for every word, all of one length; -1: a letter of no word here."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, -1)

    def exact(self, way: int, at: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """Both intervals after one more symbol, on the left (``way`` 0) or on the right (1)."""
        step = self.sides[way].step
        low, high = step[at], step[at + size]
        wide = (high - low).astype(np.int64)
        row = np.arange(len(at))
        known = np.maximum(symbol, 0)
        before = np.cumsum(wide, axis=1)[row, known] - wide[row, known]
        return low[row, known].astype(np.int64), other + before, np.where(symbol < 0, 0, wide[row, known])

    def one_error(self, way: int, at, size, query, edge: np.ndarray, change: bool, add: bool, drop: bool):
        """``(query, word)`` of all matches that extend the given intervals over
        ``edge`` (a row of symbols per query, nearest first) and the delimiter
        with exactly one error: a changed, an additional or a dropped letter."""
        step, length = self.sides[way].step, edge.shape[1]
        late_at, late_size, late_q = (np.zeros(0, np.int64) for _ in range(3))
        for i in range(length + 1):
            low = step[at].astype(np.int64)
            wide = step[at + size] - low
            wide[:, 0] = 0                                     # no error is a delimiter
            to = [(late_at, late_size, late_q)]
            if add:
                r, c = np.nonzero(wide)
                to.append((low[r, c], wide[r, c], query[r]))
            late_at, late_size, late_q = (np.concatenate(x) for x in zip(*to))
            want = edge[late_q, i] if i < length else np.zeros(len(late_q), np.int64)
            a, b = step[late_at, np.maximum(want, 0)].astype(np.int64), step[late_at + late_size, np.maximum(want, 0)]
            ok = (want >= 0) & (b > a)
            late_at, late_size, late_q = a[ok], b[ok] - a[ok], late_q[ok]
            if i == length:
                return late_q, self.owner[way][late_at]
            to, want = [(late_at, late_size, late_q)], edge[query, i]
            row, known = np.arange(len(query)), np.maximum(want, 0)
            if drop:
                to.append((at, size, query))
            if change:
                others = wide.copy()
                others[row[want >= 0], want[want >= 0]] = 0
                r, c = np.nonzero(others)
                to.append((low[r, c], others[r, c], query[r]))
            late_at, late_size, late_q = (np.concatenate(x) for x in zip(*to))
            go = np.flatnonzero((want >= 0) & (wide[row, known] > 0))
            at, size, query = low[go, want[go]], wide[go, want[go]], query[go]

    def near(self, words: list[str], change: bool = True, add: bool = True, drop: bool = True, block: int = 2048):
        """``(position in words, position in the vocabulary)`` of all pairs that
        differ by exactly one edit; ``words`` have one length."""
        found = []
        for begin in range(0, len(words), block):
            rows = self.symbols(words[begin:begin + block])
            count, half = len(rows), rows.shape[1] // 2
            delimiter = np.zeros((count, 1), np.int64)
            left, right = rows[:, :half], rows[:, half:]
            for way, kept, edge in ((0, np.hstack([left[:, ::-1], delimiter]), right), (1, np.hstack([right, delimiter]), left[:, ::-1])):
                at, other, size = np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, self.size)
                query = np.arange(count)
                for i in range(kept.shape[1]):
                    at, other, size = self.exact(way, at, other, size, kept[query, i])
                    live = size > 0
                    at, other, size, query = at[live], other[live], size[live], query[live]
                if len(query):
                    q, w = self.one_error(1 - way, other, size, query, edge, change, add, drop)
                    found.append((q + begin) * self.size + w)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // self.size, pairs % self.size


# --- search -----------------------------------------------------------------

def _looked_up(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
    asks = unit["asks"].to_numpy().astype(bool)
    words = unit["word"].to_pylist()
    count = unit["n"].to_numpy()
    known, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    out = {"word": [], "n_near": [], "best_n": [], "best": []}
    if len(known) and len(queries):
        kind = key[0].as_py()
        index = Vocabulary([words[i] for i in known])
        length = np.array([len(words[i]) for i in queries])
        for size in np.unique(length):
            mine = queries[length == size]
            mixed = kind >= LONGEST
            q, w = index.near([words[i] for i in mine], mixed or size == kind, mixed or size < kind, mixed or size > kind)
            if not len(q):
                continue
            found = known[w]
            order = sorted(range(len(q)), key=lambda j: (q[j], -count[found[j]], words[found[j]]))
            first = np.concatenate([[True], np.diff(q[order]) != 0])
            total = np.bincount(q)
            for j in np.array(order)[first]:
                out["word"].append(words[mine[q[j]]])
                out["n_near"].append(int(total[q[j]]))
                out["best_n"].append(int(count[found[j]]))
                out["best"].append(words[found[j]])
    return pa.table([pa.array(out["word"], pa.string()), pa.array(out["n_near"], pa.int64()),
                     pa.array(out["best_n"], pa.int64()), pa.array(out["best"], pa.string())], names=list(out))


def _kind(word):
    return F.least(F.char_length(word), F.lit(LONGEST))


def near_words(words: DataFrame, part_letters: int = PART_LETTERS, block: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` for every word of the staged ``(word, n)``
    that has a near word: how many, and the near word of largest count
    (ties: smallest) with that count."""
    spark = words.sparkSession
    kinds = {r["kind"]: (r["words"], r["letters"]) for r in words.groupBy(_kind("word").alias("kind")).agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.char_length("word") + 1).alias("letters")).collect()}    # LONGEST rows at most
    sizes = [(k, -(-letters // part_letters), -(-sum(kinds.get(j, (0, 0))[0] for j in (k - 1, k, k + 1)) // block))
             for k, (_, letters) in kinds.items()]
    sizes = spark.createDataFrame(sizes, "kind int, parts long, blocks long")
    word = F.col("word")
    kept = words.withColumn("kind", _kind(word)).join(F.broadcast(sizes), "kind").select(
        "kind", F.pmod(F.xxhash64("word"), F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "word", "n")
    length = F.char_length(word)
    around = F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda x: F.least(x, F.lit(LONGEST))))
    asked = words.withColumn("kind", F.explode(around)).join(F.broadcast(sizes), "kind").select(
        "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).alias("block"), F.lit(True).alias("asks"), "word", "n")
    found = kept.union(asked).groupBy("kind", "part", "block").applyInArrow(
        _looked_up, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")) \
                .select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word with a form, from staged ``(word, form)``:
    each round follows twice as many steps."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = 2,
             part_letters: int = PART_LETTERS, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every counted word: its form
    is the near word of largest count where that is at least ``ratio`` times
    its own, its root the end of the chain of forms."""
    words = stage(word_counts(docs, letters, least), "spelling-words")
    near = near_words(words, part_letters, block)
    enough = F.col("best_n") >= ratio * F.col("n")
    rows = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "spelling-forms")
    end = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
