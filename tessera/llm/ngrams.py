"""Vectorised word and character n-gram lookups (numpy / Arrow, inside tasks).

Texts are split once per Arrow batch; every distinct word of the batch is
looked at once, whatever its number of occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TRIM = ".,;:!?\"'()[]{}<>|*#$%&_-+=/\\@~^`"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BEGIN, _END = 2, 3


def slices(texts: pa.Array, budget: int = 4 << 20):
    """``(start, array)`` slices of about ``budget`` bytes (at least one row),
    so that memory does not follow the batch size."""
    texts = pc.fill_null(texts, "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + budget, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, normal: bool = True):
    """``(offsets, index, distinct)``: word ``j`` of text ``i`` is
    ``distinct[index[offsets[i] + j]]``. ``normal`` lower-cases and trims
    punctuation (a bare punctuation run becomes the empty word)."""
    parts = pc.ascii_split_whitespace(texts)
    raw = parts.flatten().dictionary_encode()
    index = raw.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = raw.dictionary
    if normal:
        core = pc.utf8_trim(pc.utf8_lower(words), TRIM).dictionary_encode()
        index, words = core.indices.to_numpy(zero_copy_only=False).astype(np.int64)[index], core.dictionary
    return parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64), index, words


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Letters:
    """Code points of words laid out one after another, each word between a
    begin and an end mark."""

    def __init__(self, words: pa.Array):
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        text = "".join(f"{chr(_BEGIN)}{w}{chr(_END)}" for w in words.to_pylist())
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(size + 2)]).astype(np.int64)
        self.inside = np.arange(len(self.codes)) - np.repeat(self.starts[:-1], size + 2)  # 0 at the begin mark

    def ngrams(self, top: int):
        """For each order 1..top, one at a time, the hashes of the n-grams that
        end at each position (only meaningful where ``inside >= order - 1``)."""
        h = self.codes + np.uint64(1)
        powers = np.cumprod(np.full(top, _BASE, np.uint64))
        yield _finish(h, 1)
        acc = h.copy()
        for k in range(2, top + 1):
            power = powers[k - 2]
            acc = acc.copy()
            acc[k - 1:] += h[: len(h) - k + 1] * power
            yield _finish(acc, k)

    def word_hashes(self) -> np.ndarray:
        if not len(self.starts[:-1]):
            return np.zeros(0, np.uint64)
        power = np.ones(int(self.inside.max()) + 1, np.uint64)
        power[1:] = np.cumprod(np.full(len(power) - 1, _BASE, np.uint64))
        return _finish(np.add.reduceat((self.codes + np.uint64(1)) * power[self.inside], self.starts[:-1]), 99)


def _finish(h: np.ndarray, order: int) -> np.ndarray:
    h = (h + np.uint64(order)) * _MIX
    h ^= h >> np.uint64(32)
    h = h * _MIX
    return np.where(h == 0, np.uint64(1), h)


class Lookup:
    """Open-addressing table from 64-bit hashes to positions in ``keys``."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = ((keys[left] >> self.shift).astype(np.int64) + self.probes) & self.mask
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.keys[slot[free][first]], self.rows[slot[free][first]] = keys[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of every hash, -1 where absent."""
        slot = (h >> self.shift).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == h, self.rows[slot], -1)
        left = np.flatnonzero((seen != h) & (seen != 0))
        for p in range(1, self.probes):
            if not len(left):
                break
            at = (slot[left] + p) & self.mask
            seen = self.keys[at]
            hit = seen == h[left]
            out[left[hit]] = self.rows[at[hit]]
            left = left[~hit & (seen != 0)]
        return out
