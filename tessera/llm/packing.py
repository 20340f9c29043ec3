"""Operator 5, packing: vector bin packing by the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence
a bin with a limit in each dimension. A bin repeatedly takes the example that
fits and has the largest dot product of its vector with the room left, both as
shares of the limits. Each task packs its own rows as they stream by, from a
pool of at most ``POOL`` waiting examples, so there is no shuffle, memory does
not follow the input, a lost task is simply run again and no row depends on
another partition. Examples longer than a sequence first give whole
sequences. Where no waiting example fits a gap of more than ``slack`` tokens,
the next one is cut; a task's last, unfilled sequence is cut at powers of two.
``cut=False`` cuts only what no sequence can hold. ``op5_packing`` gives no
prompt, so there all tokens bear loss and the third limit equals the first.

Defined cases: a null text is empty; an empty one still has its end id (one
token); repeated rows are packed each; null ids stay null; extra columns are
not read. ``sequence_id`` is the task's number and a count within it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ngrams import slices
from tessera.llm.tokens import default_tokenizer, tokenizer

END_ID = 1
CAPACITY = 2048
SEGMENTS = 512
POOL = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Bins over examples ``(key, ids, loss)``; ``loss`` marks loss-bearing
    tokens (None: all of them).

    Of examples that bear loss everywhere the dot product grows with the number
    of tokens, so they wait in order of size and the best that fits is found by
    bisection; the others are compared by their vectors."""

    def __init__(self, limits, cut: bool = True, slack: int = 8, pool: int = POOL):
        self.limits = np.array(limits, float)
        self.tokens, self.loss = int(limits[0]), int(limits[2])
        self.cut, self.slack, self.pool = cut, slack, pool
        self.full: list = []                       # (tokens, number, item), in order
        self.number = 0
        self.need = np.zeros((2 * pool, 3))
        self.items: list = [None] * (2 * pool)
        self.free = list(range(2 * pool))[::-1]
        self.live = np.zeros(2 * pool, bool)

    def waiting(self) -> int:
        return len(self.full) + 2 * self.pool - len(self.free)

    def add(self, item):
        """``item`` is (key, start, ids, loss)."""
        _, _, ids, loss = item
        if loss is None or loss.all():
            self.number += 1
            insort(self.full, (len(ids), -self.number, item))
            return
        slot = self.free.pop()
        self.items[slot], self.live[slot] = item, True
        self.need[slot] = len(ids), 1, int(loss.sum())

    def take(self, slot):
        self.live[slot] = False
        self.free.append(slot)
        return self.items[slot]

    def best(self, room):
        """The waiting example that fits with the largest dot product; None if none fits."""
        share = room / self.limits ** 2
        at = bisect_left(self.full, (int(min(room[0], room[2])) + 1,)) - 1
        value, slot = -1.0, None
        if at >= 0:
            size = self.full[at][0]
            value = size * share[0] + share[1] + size * share[2]
        if len(self.free) < 2 * self.pool:
            some = np.flatnonzero(self.live & (self.need <= room).all(axis=1))
            if len(some):
                values = self.need[some] @ share
                if values.max() > value:
                    slot = int(some[values.argmax()])
        if slot is not None:
            return self.take(slot)
        return self.full.pop(at)[2] if at >= 0 else None

    def largest(self):
        """The waiting example with most tokens."""
        some = np.flatnonzero(self.live)
        slot = int(some[self.need[some, 0].argmax()]) if len(some) else None
        if slot is not None and (not self.full or self.need[slot, 0] > self.full[-1][0]):
            return self.take(slot)
        return self.full.pop()[2]

    def put(self, key, ids, loss=None):
        """Sequences that become full on the way (lists of pieces). An example
        beyond a limit is cut where the first limit is reached; only a piece
        that fills a sequence is one by itself."""
        start = 0
        borne = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        while start < len(ids):
            size = min(self.tokens, len(ids) - start)
            if loss is None:
                size = min(size, self.loss)
            else:
                size = min(size, int(np.searchsorted(borne, borne[start] + self.loss, side="right")) - 1 - start)
            if size == self.tokens or (loss is None and size == self.loss and start + size < len(ids)):
                yield [(key, start, ids[start:start + size])]
            else:
                self.add((key, start, ids[start:start + size], None if loss is None else loss[start:start + size]))
            start += size
            while self.waiting() >= self.pool:
                yield self.fill()[0]

    def fill(self):
        """One sequence out of the pool, and its length."""
        room, pieces, used = self.limits.copy(), [], 0
        while room[1] >= 1 and room[0] >= 1 and (item := self.best(room)) is not None:
            key, start, ids, loss = item
            room -= len(ids), 1, len(ids) if loss is None else int(loss.sum())
            pieces.append((key, start, ids))
            used += len(ids)
        if self.cut and room[1] >= 1 and room[0] > self.slack and self.waiting():
            key, start, ids, loss = self.largest()
            n = int(room[0])
            if loss is not None:
                n = min(n, int(np.searchsorted(np.cumsum(loss), room[2], side="right")))
            else:
                n = min(n, int(room[2]))
            n = min(n, len(ids) - 1)
            if n > 0:
                pieces.append((key, start, ids[:n]))
                used += n
            self.add((key, start + n, ids[n:], None if loss is None else loss[n:]))
        return pieces, used

    def finish(self):
        while self.waiting():
            pieces, used = self.fill()
            if not self.cut or self.waiting() or used & (used - 1) == 0:
                yield pieces
                continue
            while used:  # the task's last sequence, cut at powers of two
                size = 1 << (used.bit_length() - 1)
                part, got = [], 0
                while got < size:
                    key, start, ids = pieces.pop(0)
                    n = min(size - got, len(ids))
                    part.append((key, start, ids[:n]))
                    got += n
                    if n < len(ids):
                        pieces.insert(0, (key, start + n, ids[n:]))
                yield part
                used -= size


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS,
                   loss_tokens: int | None = None, cut: bool = True, with_ids: bool = False, prompt_words: str | None = None) -> DataFrame:
    """Pieces of the packed sequences of ``docs`` (``doc_id``, ``text``).
    ``prompt_words`` names a column with the number of white-space words at the
    start of a text that bear no loss (null or none: all tokens bear loss);
    ``with_ids`` adds the piece's ids."""
    path = path or default_tokenizer()
    limits = (capacity, segments, loss_tokens or capacity)

    def run(batches):
        coder, packer = tokenizer(path), Packer(limits, cut)
        base, count, rows = TaskContext.get().partitionId() << 40, 0, []

        def emit(pieces):
            nonlocal count
            offset = 0
            for (doc, total), start, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + count, offset,
                             ids if with_ids else None))
                offset += len(ids)
            count += 1

        def flush():
            cols = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            doc_ids, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, part in slices(batch.column(1), 8 << 20):
                offsets, ids, word = coder.encode(part, with_words=True) if prompt_words else (*coder.encode(part), None)
                for i in range(len(part)):
                    own, loss = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(END_ID)), None
                    if prompt_words and (prompts[first + i] or 0) > 0:
                        loss = np.append(word[offsets[i]:offsets[i + 1]] >= prompts[first + i], True)
                    for full in packer.put((doc_ids[first + i], len(own)), own, loss):
                        emit(full)
                if rows:
                    yield flush()
        for full in packer.finish():
            emit(full)
        if rows:
            yield flush()

    prompt = F.col(prompt_words).cast("long") if prompt_words else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), prompt.alias("prompt")) \
               .mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
