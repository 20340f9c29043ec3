"""Operator 9, language identification: word-first backoff.

A word seen more than once in training scores by its log frequency in each
language. Any other word falls back to character n-grams: at every letter the longest
known n-gram (5 down to 1 letters, with word-boundary marks) gives the score,
averaged over the word. The document takes the language with the highest sum.

Training uses a bounded sample: about ``rows_per_class`` labelled rows of each
language (whole texts) and every word and letter n-gram in them. N-grams with
equal counts share one row of scores. Prediction sees the whole text of every
row and nothing but the text.

Defined cases: a null text or one without a letter gives ``und`` and score 0;
ties go to the language that sorts first; with no labelled row at all every
text is ``und``; repeated rows each get the same answer; extra columns pass
through ``with_language`` unless they have the two output names, which are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.class_words import class_ngrams, class_word_counts, class_words
from tessera.llm.common import held_out, own_names, sampled_rows
from tessera.llm.ngrams import Letters, Lookup, segment_sum, slices, split_words

UND = "und"
TOP = 5


class Model:
    def __init__(self, languages, words, counts, orders: list, alpha: float = 0.5):
        """``words`` and ``counts`` of ``class_words``, ``orders`` of ``class_ngrams``."""
        self.languages = languages
        keep = counts.sum(axis=1) > 1
        total = counts.sum(axis=0) + 1
        self.word_at = Lookup(Letters(words.filter(pa.array(keep))).word_hashes())
        self.word_row, n = _shared_rows(counts[keep])
        self.word_score = _centred((n + alpha) / (total + alpha * max(1, keep.sum())))
        self.orders, self.order_row, self.order_score = [], [], []
        for o in orders:
            row, n = _shared_rows(o["raw"])
            self.orders.append(Lookup(o["keys"]))
            self.order_row.append(row)
            self.order_score.append(_centred((n + alpha) / (o["raw"].sum(axis=0) + alpha * max(1, len(row)) + 1)))

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Scores words x languages, each row centred."""
        letters = Letters(words)
        at = self.word_at.find(letters.word_hashes())
        out = np.zeros((len(words), len(self.languages)), np.float32)
        known = at >= 0
        out[known] = self.word_score[self.word_row[at[known]]]
        new = words.filter(pa.array(~known))
        if len(new):
            part = Letters(new)
            score = np.zeros((len(part.codes), len(self.languages)), np.float32)
            for k, h in enumerate(part.ngrams(TOP), 1):
                ok = np.flatnonzero(part.inside >= max(1, k - 1))
                found = self.orders[k - 1].find(h[ok])
                score[ok[found >= 0]] = self.order_score[k - 1][self.order_row[k - 1][found[found >= 0]]]
            sums = np.add.reduceat(score, part.starts[:-1], axis=0)
            out[~known] = sums / np.diff(part.starts)[:, None]
        out[np.asarray(words.to_numpy(zero_copy_only=False) == "")] = 0
        return out


def _shared_rows(counts: np.ndarray):
    """Each row's place among the distinct rows, and these."""
    if not counts.size:
        return np.zeros(len(counts), np.int32), counts
    rows, place = np.unique(counts, axis=0, return_inverse=True)
    return place.reshape(-1).astype(np.int32), rows


def _centred(p: np.ndarray) -> np.ndarray:
    p = np.log(np.maximum(p, 1e-12))
    return (p - p.mean(axis=1, keepdims=True)).astype(np.float32) if p.size else p.astype(np.float32)


def train(docs: DataFrame, rows_per_class: int = 4000, seed: int = 9) -> Model:
    """Model from the labelled rows of ``docs`` outside the held-out fold."""
    mine = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & (F.col("lang") != UND))
    chosen = sampled_rows(mine, "lang", rows_per_class, seed).select("doc_id").distinct()
    texts = mine.join(F.broadcast(chosen), "doc_id", "left_semi")  # bounded by the sample
    counts = class_word_counts(texts, "lang")
    languages, orders = class_ngrams(counts, TOP)
    return Model(languages, *class_words(counts, languages), orders)


@own_names
def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        names, scores = [], []
        for _, part in slices(texts):
            offsets, index, words = split_words(part)
            per_word = m.word_scores(words)
            sums = np.stack([segment_sum(per_word[:, c][index], offsets) for c in range(len(m.languages))], axis=1) \
                if m.languages else np.zeros((len(part), 0))
            if not m.languages:
                names += [UND] * len(part)
                scores.append(np.zeros(len(part)))
                continue
            best = sums.argmax(axis=1)
            top = np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0))
            names += [m.languages[b] for b in best]
            scores.append(1.0 / top.sum(axis=1))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.drop("lang_pred", "score", "__guess").withColumn("__guess", predict(F.coalesce("text", F.lit(""))))
    return out.withColumn("lang_pred", F.when(lettered, F.col("__guess.lang_pred")).otherwise(F.lit(UND))) \
              .withColumn("score", F.when(lettered, F.col("__guess.score")).otherwise(F.lit(0.0))).drop("__guess")
