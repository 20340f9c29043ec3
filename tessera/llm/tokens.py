"""Public tokenizer over Arrow batches: every distinct white-space run of a
batch is encoded once, and the ids of short runs are kept for later batches of
the process (at most ``KNOWN`` runs; those not seen lately go first).

Exact because the vocabulary's tokenizer drops white space before it merges.
Runs of Latin-1 letters with at most one final ``.`` or ``,`` are encoded as
their lower-case letters plus that mark, many per call; all others one by one.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.ngrams import segment_sum, split_words

_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
_GROUP = 2000
KNOWN = 1 << 19         # with their ids about 25 MB
_SHORT = 40             # code points; longer runs are not kept


@lru_cache(maxsize=4)
def tokenizer(path: str) -> "WordTokenizer":
    return WordTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """Ids of words encoded before, as flat arrays: about 50 bytes a word."""

    def __init__(self, most: int = KNOWN):
        self.most, self.clock = most, 0
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def ids_of(self, words: pa.Array, encode):
        """Flat ids and lengths of distinct words; ``encode`` is asked only for
        those whose ids are not kept."""
        self.clock += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new, known = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        fresh = words.take(pa.array(new))
        ids, size = encode(fresh.to_pylist()) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        self.used[at[known]] = self.clock
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        starts[new], sizes[new] = len(self.ids) + np.cumsum(size) - size, size
        flat = gather(np.concatenate([self.ids, ids]), starts, sizes)
        self._keep(fresh, ids, size)
        return flat, sizes

    def _keep(self, words: pa.Array, ids: np.ndarray, size: np.ndarray):
        short = pc.less_equal(pc.utf8_length(words), _SHORT).to_numpy(zero_copy_only=False)
        if not short.any():
            return
        begin = np.cumsum(size) - size
        ids, size = gather(ids, begin[short], size[short]), size[short]
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(short)).cast(pa.string())])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, size])
        self.used = np.concatenate([self.used, np.full(len(size), self.clock)])
        if len(self.words) > self.most:
            last = np.sort(np.argsort(-self.used, kind="stable")[:self.most // 2])
            self.words, self.ids = self.words.take(pa.array(last)), gather(self.ids, self.starts[last], self.sizes[last])
            self.sizes, self.used = self.sizes[last], self.used[last]
            self.starts = np.cumsum(self.sizes) - self.sizes


class WordTokenizer:
    """A word-level BPE file of the ``tokenizers`` library whose pieces mark
    the end of a word."""

    def __init__(self, path: str):
        # one thread: Spark deals the work over cores, and the library's own threads only add to it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.inner = Tokenizer.from_file(path)
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known = Remembered()
        self.marks = {m: self._one_by_one([m])[0] for m in (".", ",")}

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast(words, add_special_tokens=False)]

    def _each(self, listed: list[str]):
        each = self._one_by_one(listed)
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _letters(self, listed: list[str]):
        """Flat ids and lengths of distinct lower-case letter words."""
        groups = [" ".join(listed[i:i + _GROUP]) for i in range(0, len(listed), _GROUP)]
        ids = np.array([i for e in self._one_by_one(groups) for i in e], dtype=np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(listed):
            return self._each(listed)
        return ids, np.diff(np.concatenate([[0], last]))

    def words(self, words: pa.Array):
        """``(ids, starts, lengths)`` per distinct white-space run."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        simple = words.filter(pa.array(plain))
        core = pc.utf8_lower(pc.utf8_rtrim(simple, ".,")).dictionary_encode()
        ids, size = self.known.ids_of(core.dictionary, self._letters)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        of = core.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mark = np.where(pc.ends_with(simple, ".").to_numpy(zero_copy_only=False), 1,
                        np.where(pc.ends_with(simple, ",").to_numpy(zero_copy_only=False), 2, 0))
        tails = [np.array([], np.uint32), *(np.array(self.marks[m], np.uint32) for m in (".", ","))]
        flat_other, size_other = self.known.ids_of(words.filter(pa.array(~plain)), self._each)
        # layout: letter words, the same words again where a mark follows, the rest
        flat, starts, lengths = [ids], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        where = np.flatnonzero(plain)
        bare = mark == 0
        starts[where[bare]], lengths[where[bare]] = at[of[bare]], size[of[bare]]
        used = len(ids)
        for m in (1, 2):
            chosen = np.flatnonzero(mark == m)
            piece = gather(ids, at[of[chosen]], size[of[chosen]])
            both = size[of[chosen]] + len(tails[m])
            begin = np.concatenate([[0], np.cumsum(both)])
            joined = np.zeros(int(begin[-1]), np.uint32)
            keep = np.ones(len(joined), bool)
            for j, t in enumerate(tails[m]):
                spot = begin[1:] - len(tails[m]) + j
                joined[spot], keep[spot] = t, False
            joined[keep] = piece
            starts[where[chosen]], lengths[where[chosen]] = used + begin[:-1], both
            flat.append(joined)
            used += len(joined)
        rest = np.flatnonzero(~plain)
        starts[rest] = used + np.concatenate([[0], np.cumsum(size_other)])[:-1]
        lengths[rest] = size_other
        return np.concatenate([*flat, flat_other]), starts, lengths

    def encode(self, texts: pa.Array, with_words: bool = False):
        """``(offsets, ids)``: the ids of text ``i`` are ``ids[offsets[i]:offsets[i + 1]]``.
        ``with_words`` adds, per id, which white-space word of its text it is in."""
        offsets, index, words = split_words(texts, normal=False)
        flat, starts, lengths = self.words(words)
        ids = gather(flat, starts[index], lengths[index])
        ends = np.concatenate([[0], np.cumsum(lengths[index])])
        if not with_words:
            return ends[offsets], ids
        full = pc.binary_length(words).to_numpy(zero_copy_only=False)[index] > 0          # white space at either end splits off an empty word
        number = np.cumsum(full) - 1
        before = np.concatenate([[0], np.cumsum(full)])[offsets[:-1]]
        number = number - np.repeat(before, np.diff(offsets))
        return ends[offsets], ids, np.repeat(number, lengths[index])

    def word_and_token_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, index, words = split_words(texts, normal=False)
        _, _, lengths = self.words(words)
        full = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[index]
        return tuple(segment_sum(x, offsets).astype(np.int64) for x in (full, lengths[index]))

    def counts(self, texts: pa.Array) -> np.ndarray:
        offsets, index, words = split_words(texts, normal=False)
        _, _, lengths = self.words(words)
        return segment_sum(lengths[index], offsets).astype(np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + length]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
