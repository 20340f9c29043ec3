"""Operator 11, phrase collocation mining with counting quotient filters.

Texts are read once and written as chunks: the distinct words of a slice of
texts of one language and the slice as word numbers. Words that occur often
enough get ids; rarer ones, like piece ends, break a phrase, since no phrase is
more frequent than its words.

An n-gram is its word ids packed into two halves, and a keyed Feistel
permutation deals them evenly and invertibly. The leading bits of the permuted
value are the quotient, all others the remainder, so a filter (a run length per
quotient, remainders in order, one byte per counter and the large counters
apart) holds every n-gram exactly. Every chunk makes one filter and sends its
slices to shards of the quotient range; a shard merges the sorted slices, adds
their counters and turns the frequent entries back into ids. Quotients are
uniform whatever the words are, and a frequent phrase is one entry per chunk,
so no shard is hot.

Two rounds are enough: first two-word phrases; each shard returns to every
chunk one bit per entry it sent, frequent or not. Three- and four-word phrases
are counted only where all their two-word parts are frequent, which loses none.

Scores come from joins of the frequent phrases with their parts. They are
exact decimals; of the cuts of a phrase the lowest score counts, then the
smallest first part.

Defined cases: null and empty texts have no word; a null language is ``und``;
repeated rows count again; ties go to the smaller phrase in UTF-8 byte order;
other columns, whatever their names, are not read; a language without a
frequent phrase gives no row, nor does an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

LEAST, COVER, TOP = 30, 80, 2000
CHUNK = 3 << 20             # bytes of text in a chunk
SHARD = 1 << 20             # words that share a shard, on average
QUOTIENT = 18               # bits
NONE = -1
_ENDS = r"[.,;:!?\x0A-\x0D]+"
_KEYS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


# --- chunks -----------------------------------------------------------------

def _split(texts: pa.Array):
    """Distinct words of the slice, their counts, and every text as word
    numbers with -1 for a piece end."""
    marked = pc.binary_join_element_wise(pc.replace_substring_regex(pc.ascii_lower(texts), _ENDS, " . "), " .", "")
    flat = pc.ascii_split_whitespace(marked).flatten().dictionary_encode()
    index, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    end = np.asarray(pc.equal(words, ".").to_numpy(zero_copy_only=False), bool)
    index = index[size[index] > 0]
    real = (size > 0) & ~end
    number = np.full(len(words), -1, np.int32)
    number[real] = np.arange(real.sum(), dtype=np.int32)
    tokens = number[index]
    return words.filter(pa.array(real)), np.bincount(tokens[tokens >= 0], minlength=int(real.sum())), tokens


def _chunked(batches):
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lot = np.concatenate([[0], size[:-1]]) // CHUNK if len(size) else size
        for part in np.unique(lot):
            rows = np.flatnonzero(lot == part)
            first, count = int(rows[0]), len(rows)                             # a lot is a run of rows
            mine, said = pc.fill_null(texts.slice(first, count), ""), langs.slice(first, count)
            for lang in said.unique():
                words, counts, tokens = _split(mine.filter(pc.equal(said, lang)))
                if len(words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.as_py()]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())),
                         pa.array([tokens.tobytes()], pa.binary())], ["lang", "words", "counts", "tokens"])
            pa.default_memory_pool().release_unused()


def _coded(batches):
    for batch in batches:
        out = []
        for i in range(len(batch)):
            tokens = np.frombuffer(batch["tokens"][i].as_buffer(), np.int32)
            ids = np.full(int(tokens.max(initial=0)) + 2, NONE, np.int32)          # the last one stands for a piece end
            at = batch["ids"][i].values
            ids[at.field("at").to_numpy()] = at.field("id").to_numpy()
            out.append(ids[tokens].tobytes())
        yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array(out, pa.binary())], ["chunk", "ids"])


def vocabulary(chunks: DataFrame, least: int) -> DataFrame:
    """``(lang, word, f, id)`` of the words with at least ``least``
    occurrences; ids are dense (rows of a written part, numbered on)."""
    word = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    often = word.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    often = stage(often.withColumn("at", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted((r["part"], r["count"]) for r in often.groupBy(part).count().collect())     # one row per shuffle partition
    base = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    base = chunks.sparkSession.createDataFrame(base, "part long, base long")
    return stage(often.withColumn("part", part).join(F.broadcast(base), "part").select(
        "lang", "word", "f", (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")), "phrase-words")


# --- counting quotient filters ----------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permuted(high: np.ndarray, low: np.ndarray, half: int):
    """Feistel permutation of two ``half``-bit numbers."""
    for key in _KEYS:
        high, low = low, high ^ (_mix(low ^ key) >> np.uint64(64 - half))
    return high, low


def restored(high: np.ndarray, low: np.ndarray, half: int):
    for key in _KEYS[::-1]:
        high, low = low ^ (_mix(high ^ key) >> np.uint64(64 - half)), high
    return high, low


def tally(high: np.ndarray, low: np.ndarray, weight: np.ndarray | None = None):
    """Distinct pairs in order, their summed weights, and for each input its place."""
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])]) if len(h) else np.zeros(0, bool)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    count = np.bincount(place, minlength=int(new.sum())) if weight is None else \
        np.add.reduceat(weight[order], np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)
    return h[new], l[new], count, place


class Layout:
    """Bits of a filter: ``half`` bits in either half, of which the first
    ``quotient`` of the first half are the quotient and the first ``shards``
    of these the shard."""

    def __init__(self, half: int, shards: int):
        self.half, self.quotient = half, min(QUOTIENT, half)
        self.shards = min(shards, self.quotient)
        self.rest = half - self.quotient
        self.width = -(-self.rest // 8), -(-half // 8)

    def shard(self, high: np.ndarray) -> np.ndarray:
        return (high >> np.uint64(self.half - self.shards)).astype(np.int64) if self.shards else np.zeros(len(high), np.int64)

    def encode(self, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Sorted distinct entries of one shard as run marks (per quotient a 1
        for each entry, then a 0), remainders, and counters."""
        quotient = (high >> np.uint64(self.rest)).astype(np.int64) & ((1 << self.quotient - self.shards) - 1)
        marks = np.zeros(len(high) + (1 << self.quotient - self.shards), np.uint8)
        marks[quotient + np.arange(len(high))] = 1
        rest = _bytes(high & np.uint64((1 << self.rest) - 1), self.width[0]), _bytes(low, self.width[1])
        large = count >= 255
        return np.packbits(marks).tobytes(), np.hstack(rest).tobytes(), \
            np.where(large, 255, count).astype(np.uint8).tobytes() + count[large].astype("<i8").tobytes()

    def decode(self, shard: int, marks: bytes, rest: bytes, counts: bytes):
        width = sum(self.width)
        size = len(rest) // width
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8)))
        quotient = (ones - np.arange(size)).astype(np.uint64) + np.uint64(shard << self.quotient - self.shards)
        rows = np.frombuffer(rest, np.uint8).reshape(size, width)
        high = (quotient << np.uint64(self.rest)) | _numbers(rows[:, :self.width[0]])
        count = np.frombuffer(counts[:size], np.uint8).astype(np.int64)
        count[count == 255] = np.frombuffer(counts[size:], "<i8")
        return high, _numbers(rows[:, self.width[0]:]), count


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _numbers(rows: np.ndarray) -> np.ndarray:
    full = np.zeros((len(rows), 8), np.uint8)
    full[:, :rows.shape[1]] = rows
    return full.view("<u8").reshape(-1)


def _slices(chunk: int, high, low, count, layout: Layout):
    """Rows of the chunk's filter, one per shard that it reaches."""
    shard = layout.shard(high)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    rows = [(int(shard[a]), chunk, *layout.encode(high[a:b], low[a:b], count[a:b])) for a, b in zip(edges[:-1], edges[1:]) if b > a]
    return pa.RecordBatch.from_pylist([dict(zip(("shard", "chunk", "marks", "rest", "counts"), r)) for r in rows], SLICE)


SLICE = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("marks", pa.binary()), ("rest", pa.binary()), ("counts", pa.binary())])
SLICE_SQL = "shard int, chunk long, marks binary, rest binary, counts binary"


def _pairs(ids: np.ndarray, half: int):
    """Positions and distinct permuted two-word phrases of a chunk."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    high, low = permuted(ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64), half)
    return at, *tally(high, low)


def _two_words(layout: Layout):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                _, high, low, count, _ = _pairs(np.frombuffer(batch["ids"][i].as_buffer(), np.int32), layout.half)
                if len(high):
                    yield _slices(batch["chunk"][i].as_py(), high, low, count, layout)
                pa.default_memory_pool().release_unused()
    return run


def _more_words(layout: Layout, longer: Layout, width: int):
    """Three and four words, where the returned bits say that all two-word parts are frequent."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = np.frombuffer(batch["ids"][i].as_buffer(), np.int32)
                at, high, _, _, place = _pairs(ids, layout.half)
                shard, often = layout.shard(high), np.zeros(len(high), bool)
                for answer in batch["answers"][i].as_py():
                    a, b = np.searchsorted(shard, [answer["shard"], answer["shard"] + 1])
                    often[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
                go = np.zeros(len(ids) + 2, bool)
                go[at] = often[place]
                three = np.flatnonzero(go[:-1] & go[1:])
                four = three[go[three + 2]]
                none = (1 << width) - 1
                start = np.concatenate([three, four])
                last = np.concatenate([np.full(len(three), none), ids[four + 3]])
                first, second, third, last = (x.astype(np.uint64) for x in (ids[start], ids[start + 1], ids[start + 2], last))
                shift = np.uint64(width)
                high, low = permuted(first << shift | second, third << shift | last, longer.half)
                high, low, count, _ = tally(high, low)
                if len(high):
                    yield _slices(batch["chunk"][i].as_py(), high, low, count, longer)
    return run


TOTALS_SQL = "chunk long, shard int, bits binary, g1 long, g2 long, g3 long, g4 long, f long"


def _merged(layout: Layout, width: int, least: int, answers: bool):
    """Merge the slices of a shard: its frequent phrases, and for every chunk
    which of the entries it sent are frequent."""
    def run(key: tuple[pa.Scalar, ...], slices: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts = [layout.decode(shard, m, r, c) for m, r, c in zip(*(slices[n].to_pylist() for n in ("marks", "rest", "counts")))]
        high, low, count, place = tally(*(np.concatenate(x) for x in zip(*parts)))
        often = count >= least
        ends = np.cumsum([len(p[0]) for p in parts])
        chunk, bits = [], []
        if answers:
            for c, flags in zip(slices["chunk"].to_pylist(), np.split(often[place], ends[:-1])):
                if flags.any():
                    chunk.append(c)
                    bits.append(np.packbits(flags).tobytes())
        high, low = (x.astype(np.int64) for x in restored(high[often], low[often], layout.half))
        if layout.half == width:
            words = [high, low, np.full(len(high), NONE), np.full(len(high), NONE)]
        else:
            mask = (1 << width) - 1
            last = low & mask
            words = [high >> width, high & mask, low >> width, np.where(last == mask, NONE, last)]
        blank, more = len(chunk), int(often.sum())
        return pa.table([pa.array(chunk + [None] * more, pa.int64()), pa.array([shard] * (blank + more), pa.int32()),
                         pa.array(bits + [None] * more, pa.binary()),
                         *(pa.array([None] * blank + w.tolist(), pa.int64()) for w in words),
                         pa.array([None] * blank + count[often].tolist(), pa.int64())], names=["chunk", "shard", "bits", "g1", "g2", "g3", "g4", "f"])
    return run


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(frequent, words, totals)``: all frequent phrases of one to four words
    as ``(g1..g4, f)`` (-1 behind the last word), the words behind the ids, and
    ``(lang, n)`` with all word occurrences."""
    lang = F.coalesce("lang", F.lit("und"))
    chunks = docs.select(lang.alias("lang"), "text").mapInArrow(_chunked, "lang string, words array<string>, counts array<long>, tokens binary")
    chunks = stage(chunks.withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")
    words = vocabulary(chunks, least)
    totals = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))

    said = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    ids = said.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    coded = stage(chunks.select("chunk", "tokens").join(ids, "chunk").select("chunk", "tokens", "ids").mapInArrow(_coded, "chunk long, ids binary"), "phrase-ids")

    known, size = words.count(), coded.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 1
    width = max(1, int(known + 1).bit_length())
    shards = max(0, int(np.ceil(np.log2(max(1.0, size / SHARD)))))
    two, more = Layout(width, shards), Layout(2 * width, shards)

    def merge(slices, layout, answers):
        return slices.groupBy("shard").applyInArrow(_merged(layout, width, least, answers), TOTALS_SQL)
    counted = stage(merge(coded.mapInArrow(_two_words(two), SLICE_SQL), two, True), "phrase-pairs")
    answers = counted.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
    longer = coded.join(answers, "chunk").select("ids", "chunk", "answers").mapInArrow(_more_words(two, more, width), SLICE_SQL)
    longer = stage(merge(longer, more, False), "phrase-longer")
    gram = ["g1", "g2", "g3", "g4", "f"]
    none = F.lit(NONE).cast("long")
    single = words.select(F.col("id").alias("g1"), none.alias("g2"), none.alias("g3"), none.alias("g4"), "f")
    return single.union(counted.filter("chunk is null").select(gram)).union(longer.select(gram)), words, totals


# --- scores -----------------------------------------------------------------

def _parts(*columns):
    """A phrase key from some of the words."""
    columns = [F.col(c) for c in columns] + [F.lit(NONE).cast("long")] * (4 - len(columns))
    return F.struct(*(c.alias(f"g{i + 1}") for i, c in enumerate(columns)))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every
    language by score, count, then phrase."""
    frequent, words, totals = phrases(docs, least)
    key = F.struct("g1", "g2", "g3", "g4")
    counts = frequent.select(key.alias("key"), F.col("f"))
    phrase = frequent.filter(F.col("g2") >= 0).select(key.alias("key"), "g1", "g2", "g3", "g4", F.col("f").alias("a"))
    cut = F.explode(F.filter(F.array(
        F.struct(F.lit(1).alias("k"), _parts("g1").alias("left"), _parts("g2", "g3", "g4").alias("right")),
        F.when(F.col("g3") >= 0, F.struct(F.lit(2).alias("k"), _parts("g1", "g2").alias("left"), _parts("g3", "g4").alias("right"))),
        F.when(F.col("g4") >= 0, F.struct(F.lit(3).alias("k"), _parts("g1", "g2", "g3").alias("left"), _parts("g4").alias("right")))),
        lambda c: c.isNotNull()))
    cuts = phrase.select("key", "a", cut.alias("c")).select("key", "a", "c.k", "c.left", "c.right")
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left") \
               .join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    big = "decimal(38,0)"
    score = F.expr(f"cast((cast(2000000 as {big}) * cast(a as {big})) div (cast(l as {big}) + cast(r as {big})) as long)")
    scored = cuts.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = F.array_distinct(F.filter(F.array(
        F.when(F.col("g3") >= 0, _parts("g1", "g2")), F.when(F.col("g3") >= 0, _parts("g2", "g3")), F.when(F.col("g4") >= 0, _parts("g3", "g4")),
        F.when(F.col("g4") >= 0, _parts("g1", "g2", "g3")), F.when(F.col("g4") >= 0, _parts("g2", "g3", "g4"))), lambda c: c.isNotNull()))
    covered = phrase.select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    alone = F.col("longer").isNull() | (F.lit(100).cast(big) * F.col("longer").cast(big) < F.lit(cover).cast(big) * F.col("a").cast(big))
    left = scored.join(covered, "key", "left").filter(alone).select("key", "a", "best.*").drop("k")

    placed = left.join(words.select(F.col("id").alias("first"), "lang"), F.col("key.g1") == F.col("first")).drop("first")
    near_top = placed.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= top)
    spelt = near_top.select("lang", "key", "a", "l", "r", "score", F.posexplode(F.filter(F.array("key.g1", "key.g2", "key.g3", "key.g4"), lambda g: g >= 0)).alias("at", "id")) \
                    .join(words.select("id", "word"), "id").groupBy("lang", "key", "a", "l", "r", "score") \
                    .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")) \
                    .withColumn("phrase", F.concat_ws(" ", F.transform("w", lambda x: x["word"])))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return spelt.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).join(totals, "lang") \
                .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
