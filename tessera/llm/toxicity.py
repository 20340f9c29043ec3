"""Operator 2, toxicity: class-conditional Kneser-Ney models.

One interpolated Kneser-Ney character model (orders up to 6 within words, with
boundary marks) per class, toxic and ordinary. The lowest order is counted over
both classes together, so an expression that is rare in either class backs off
to shared counts. A document compares the two log-likelihoods, normalised by
length, over its one, two and five strongest words and over the whole text. A logistic curve fitted on training rows that the
language models did not see turns these into the score.

Training uses a bounded sample of labelled rows outside the held-out fold:
about ``rows_per_class`` of each class (whole texts), with every word and
letter n-gram in them; all documents are scored by whole text and by nothing
else.

Defined cases: null and empty texts get the score of no evidence; ids that
``labels`` repeats with both values train both classes; without rows of both
classes every score is 0; repeated rows score alike; extra columns pass
through ``with_toxicity`` unless they have the output names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.class_words import class_ngrams, class_word_counts
from tessera.llm.common import held_out, own_names, sampled_rows
from tessera.llm.ngrams import Letters, Lookup, segment_sum, slices, split_words

TOP, SHARED = 6, 1
LONG = 14           # letters and marks; longer words count by their mean per letter
THRESHOLD = 0.3
STRONGEST = (1, 2, 5)   # means over so many strongest words
FEATURES = len(STRONGEST) + 1


class Model:
    """Differences of the two log-likelihoods: ``ratio`` of every known n-gram
    and ``backoff`` of every known context."""

    def __init__(self, orders: list):
        """``orders`` of ``class_ngrams``, classes ordinary and toxic."""
        for k in range(1, TOP):  # adjusted counts: distinct letters before, unless the n-gram begins a word
            low, high = orders[k - 1], orders[k]
            into = np.searchsorted(low["keys"], high["tail"])
            kinds = np.stack([np.bincount(into, weights=high["raw"][:, c] > 0, minlength=len(low["keys"])) for c in (0, 1)], axis=1)
            low["count"] = np.where(low["begins"][:, None], low["raw"], kinds)
        orders[-1]["count"] = orders[-1]["raw"]
        p = None
        for k, o in enumerate(orders, 1):
            n = o["count"]
            if k <= SHARED:
                n = np.repeat(n.sum(axis=1, keepdims=True), 2, axis=1)
            if k == 1:
                p = (n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(n)))
                o["p"], o["gamma"] = p, None
                continue
            below = orders[k - 2]
            heads, group = np.unique(o["head"], return_inverse=True)
            prob, gamma = np.empty_like(n), np.empty((len(heads), 2))
            into = np.searchsorted(below["keys"], o["tail"])
            for c in (0, 1):
                ones, twos = (n[:, c] == 1).sum(), (n[:, c] == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(group, weights=n[:, c], minlength=len(heads))
                kinds = np.bincount(group, weights=n[:, c] > 0, minlength=len(heads))
                gamma[:, c] = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
                lead = np.where(total[group] > 0, np.maximum(n[:, c] - d, 0) / np.maximum(total[group], 1e-9), 0.0)
                prob[:, c] = lead + gamma[group, c] * below["p"][into, c]
            o["p"], o["heads"], o["gamma"] = np.maximum(prob, 1e-30), heads, gamma
        keys, ratio, backoff = [], [], []
        for k in range(SHARED, TOP + 1):
            o = orders[k - 1]
            bow = np.zeros(len(o["keys"]), np.float32)
            if k < TOP:
                up = orders[k]
                pos = np.searchsorted(o["keys"], up["heads"])
                pos = np.minimum(pos, max(0, len(o["keys"]) - 1))
                hit = o["keys"][pos] == up["heads"] if len(o["keys"]) else np.zeros(len(pos), bool)
                g = np.maximum(up["gamma"], 1e-12)
                bow[pos[hit]] = (np.log(g[:, 1]) - np.log(g[:, 0]))[hit]
            keys.append(o["keys"])
            ratio.append((np.log(o["p"][:, 1]) - np.log(o["p"][:, 0])).astype(np.float32))
            backoff.append(bow)
        keys = np.concatenate(keys)
        self.at, self.ratio, self.backoff = Lookup(keys), np.concatenate(ratio), np.concatenate(backoff)
        self.weights = np.zeros(FEATURES + 1)
        self.centre, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def word_ratios(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood difference toxic minus ordinary of every word; beyond
        ``LONG`` letters it is scaled back to that length."""
        if not len(words):
            return np.zeros(0)
        letters = Letters(words)
        value = np.zeros(len(letters.codes), np.float32)
        before = None
        for k, grams in enumerate(letters.ngrams(TOP), 1):
            ok = letters.inside >= k - 1
            here = np.full(len(value), -1, np.int64)
            at = np.flatnonzero(ok)
            here[at] = self.at.find(grams[at])
            if k > SHARED:
                context = np.concatenate([[-1], before[:-1]])
                step = np.where(context >= 0, self.backoff[context], 0)
                value = np.where(here >= 0, self.ratio[here], np.where(ok, value + step, value))
            before = here
        sums = np.add.reduceat(value, letters.starts[:-1]).astype(np.float64)
        return sums * np.minimum(1.0, LONG / np.diff(letters.starts))

    def features(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, part in slices(texts):
            offsets, index, words = split_words(part)
            value = self.word_ratios(words)[index]
            rows = np.flatnonzero(np.diff(offsets) > 0)
            x = np.zeros((len(part), FEATURES))
            if len(rows):
                first = offsets[:-1][rows]
                of = np.repeat(np.arange(len(rows)), np.diff(offsets)[rows])
                rest, sums = value.copy(), np.zeros(len(rows))
                for k in range(1, STRONGEST[-1] + 1):
                    top = np.maximum.reduceat(rest, first)
                    sums += np.clip(top, 0, 40)
                    if k in STRONGEST:
                        x[rows, STRONGEST.index(k)] = sums / k
                    hit = np.flatnonzero(rest == top[of])
                    _, one = np.unique(of[hit], return_index=True)  # one occurrence of the strongest word
                    rest[hit[one]] = 0.0
            x[:, -1] = segment_sum(value, offsets) / np.maximum(1, np.diff(offsets))
            out.append(x)
        return np.concatenate(out) if out else np.zeros((0, FEATURES))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2):
        """Logistic curve by Newton steps."""
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale])
        w = np.zeros(z.shape[1])
        keep = np.diag([1e-6] + [ridge * len(x)  / 100] * FEATURES)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-6 * np.eye(len(w)), z.T @ (y - p) - keep @ w)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -35, 35)))


def train(docs: DataFrame, marks: DataFrame, rows_per_class: int = 4000, seed: int = 2) -> Model | None:
    """Model from the labelled rows outside the held-out fold: two thirds of
    the sample train the language models, one third the logistic curve."""
    mine = marks.select("doc_id", "toxic").filter(~held_out() & F.col("toxic").isin(0, 1)).distinct()
    chosen = sampled_rows(mine, "toxic", rows_per_class, seed)
    curve = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)) == 0
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    classes, orders = class_ngrams(class_word_counts(texts.filter(~curve), "toxic"), TOP)
    if classes != [0, 1]:
        return None
    model = Model(orders)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            x = shared.value.features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(FEATURES))],
                                             ["y", *(f"x{i}" for i in range(FEATURES))])

    seen = texts.filter(curve).select("text", F.col("toxic").cast("int").alias("y")) \
        .mapInArrow(measure, "y int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toArrow()
    y = seen.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    model.fit(np.column_stack([seen.column(f"x{i}").to_numpy() for i in range(FEATURES)]), y.astype(float))
    return model


@own_names
def with_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    out = docs.drop("score", "predicted")
    if model is None:
        return out.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return out.withColumn("score", score(F.coalesce("text", F.lit("")))) \
              .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
