"""Training objectives and loss bookkeeping computed over supplied tables of
logits / vectors / logged values (the model itself is not run here)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import logsumexp

IGNORE = -100


def masked_nll(tokens: DataFrame, logits: str = "logits", label: str = "label",
               by: list[str] | None = None) -> DataFrame:
    """Mean cross-entropy over positions whose label is not the ignore id
    (the filter runs before the per-row log-sum-exp), plus perplexity."""
    by = list(by or [])
    t = tokens.filter(F.col(label) != IGNORE)
    nll = logsumexp(logits) - F.get(F.col(logits).cast("array<double>"), F.col(label))
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_masked"), F.avg(nll).alias("nll")) \
            .withColumn("perplexity", F.exp("nll"))


def interleave(pairs: DataFrame, batch: str, pos: str, v1: str, v2: str) -> DataFrame:
    """Rows ``(batch, i, vec)`` with ``i = 2·pos`` for side 1 and ``2·pos+1``
    for side 2 — the layout whose partner index is ``i XOR 1``."""
    a = pairs.select(batch, (F.col(pos) * 2).alias("i"), F.col(v1).alias("vec"))
    b = pairs.select(batch, (F.col(pos) * 2 + 1).alias("i"), F.col(v2).alias("vec"))
    return a.unionByName(b)


def contrastive_loss(vectors: DataFrame, temperature: float, cosine: bool = False, batch: str = "batch_id",
                     negatives: float = 0.0, seed: int = 0) -> DataFrame:
    """In-batch contrastive loss per batch: for each of the 2N vectors ``(batch,
    i, vec)`` the NLL of its partner (``i XOR 1``) among the 2N−1 others, mean × 0.5.

    One Gram matrix per batch gives all similarities and their log-sum-exp by
    row, so a batch (a training parameter, not the data, bounds it) is shuffled
    once and no pair is a row. ``negatives`` random vectors per vector join every
    denominator; they are drawn again from ``seed`` where they are needed. A
    vector that is null, or zero under ``cosine``, or has no partner gives no NLL;
    a batch in which nothing is compared gives no row."""
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select(batch, F.col(batch).cast("string").alias("name"), F.col("i").cast("long").alias("i"), F.col("vec").cast("array<double>").alias("vec"))

    def loss(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        given = [v for v in group["vec"].to_pylist()]
        norm = [None if v is None or None in v else 1.0 if not cosine else float(np.sqrt(np.square(v).sum())) for v in given]
        usable = np.array([bool(n) for n in norm], bool)
        out = {"key": [], "loss": [], "n": []}
        extra = int(len(given) * negatives)
        if len(given) > 1 or extra and len(given):
            name, i = group["name"][0].as_py(), group["i"].to_numpy()[usable]
            x = np.array([np.asarray(v) / n for v, n in zip(given, norm) if n], float)
            nll = np.zeros(0)
            if len(x):
                sims = x @ x.T / temperature
                np.fill_diagonal(sims, -np.inf)
                if extra:
                    drawn = normal_vectors(seed, name, extra, x.shape[1])
                    drawn = drawn / np.sqrt(np.square(drawn).sum(axis=1, keepdims=True)) if cosine else drawn
                    sims = np.hstack([sims, x @ drawn.T / temperature])
                top = sims.max(axis=1)
                at = np.minimum(np.searchsorted(i, i ^ 1), len(i) - 1)
                paired = (i[at] == i ^ 1) & np.isfinite(top)
                with np.errstate(invalid="ignore"):
                    nll = (top + np.log(np.exp(sims - top[:, None]).sum(axis=1)) - sims[np.arange(len(i)), at])[paired]
            out = {"key": [key[0].as_py()], "loss": [float(nll.mean() * 0.5) if len(nll) else None], "n": [len(given)]}
        return pa.table([pa.array(out["key"], key[0].type), pa.array(out["loss"], pa.float64()), pa.array(out["n"], pa.int64())], names=[batch, "loss", "n_vectors"])

    return rows.groupBy(batch).applyInArrow(loss, f"`{batch}` {fields[batch]}, loss double, n_vectors long")


def normal_vectors(seed: int, name: str, count: int, dim: int) -> np.ndarray:
    """Standard-normal vectors of a batch (md5 draws keyed by seed, batch,
    number and dimension; Box-Muller): the numbers of :func:`draws.normal`."""
    def draws(tag):
        return np.array([int(hashlib.md5(f"{seed}:{name}:{k}:{d}:{tag}".encode()).hexdigest()[:8], 16)
                         for k in range(count) for d in range(dim)], float).reshape(count, dim) / 2.0 ** 32
    return np.sqrt(-2.0 * np.log(1.0 - draws("n1"))) * np.cos(2 * np.pi * draws("n2"))


def total_loss(steps: DataFrame, use_lm: bool = True, use_contrastive: bool = True, use_tlm: bool = True,
               tcm_weight: float = 1.0) -> DataFrame:
    """Objective per step from component columns ``lm_1, lm_2, tcm, tlm``."""
    z = F.lit(0.0)
    total = z
    if use_lm:
        total = total + F.coalesce("lm_1", z) + F.coalesce("lm_2", z)
    if use_contrastive:
        total = total + F.lit(tcm_weight) * F.coalesce("tcm", z)
    if use_tlm:
        total = total + F.coalesce("tlm", z)
    return steps.withColumn("total", total)


def rank_mean(losses: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cross-process mean: all ranks' values of a step averaged."""
    return losses.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_ranks"))


def log_interval_losses(step_losses: DataFrame, keys: list[str], step: str, value: str, every: int) -> DataFrame:
    """Per logging interval of ``every`` steps: the sum since the last log
    divided by the steps since the last log (steps without a row count too),
    rounded to 4 places. The last interval is logged at the last step of all.

    Values are summed as whole billionths and the quotient is rounded in whole
    numbers (half away from zero), so neither the order of the rows nor the
    partitioning decides a tie at the last place."""
    iv = F.floor((F.col(step) - 1) / every).cast("long")
    last = step_losses.agg(F.max(step)).scalar()
    units = F.round(F.col(value) * 1e9).cast("decimal(38,0)")
    sums = step_losses.groupBy(*keys, iv.alias("interval")).agg(F.sum(units).alias("__sum"))
    sums = sums.withColumn("logged_at_step", F.least((F.col("interval") + 1) * every, last)) \
               .withColumn("__part", ((F.col("logged_at_step") - F.col("interval") * every) * 100000).cast("decimal(38,0)"))
    whole = F.expr("sign(__sum) * ((2 * abs(__sum) + __part) div (2 * __part))")
    return sums.withColumn("loss", whole.cast("double") / 10000).drop("__sum", "__part")
