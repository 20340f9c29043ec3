"""Sentence pooling over token-vector tables.

Token vectors arrive as rows ``(sent_id, layer, pos, vec)`` with 0/1 mask
columns. Masked mean pooling is a masked *vector sum* divided by the mask
sum; MLlib's ``Summarizer`` computes the sum as a true partial aggregate:
each map task folds its rows into one running sum per (sentence, layer)
before the shuffle,
so the shuffle carries one vector per sentence and task instead of every
token vector.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(tokens: DataFrame, masks: dict[str, str], *, keys=("sent_id", "layer"),
              vec: str = "vec", round_to: int | None = None) -> DataFrame:
    """``Σ(vec·mask) / Σmask`` per key for every named mask column.

    ``masks`` maps output column → mask column (e.g. ``{"pooled":
    "attention_mask"}``; the training pool uses the mask without special
    tokens). A key whose mask sums to zero yields a null vector instead of
    the division by zero of the original.
    """
    keys = list(keys)
    aggs = []
    for out, m in masks.items():
        # Σ(vec·mask) as a vector sum over every row (a zero-mask row adds a
        # zero vector, so a sentence without pooled tokens still aggregates)
        masked = F.transform(F.col(vec).cast("array<double>"), lambda x: x * F.col(m).cast("double"))
        aggs.append(Summarizer.sum(array_to_vector(masked)).alias(f"__{out}"))
        aggs.append(F.sum(F.col(m)).alias(f"__{out}_w"))
    g = tokens.groupBy(*keys).agg(*aggs)
    cols = list(keys)
    for out in masks:
        w = F.col(f"__{out}_w").cast("double")
        arr = F.transform(vector_to_array(F.col(f"__{out}")), lambda x: x / w)
        if round_to is not None:
            arr = F.transform(arr, lambda x: F.round(x, round_to))
        cols.append(F.when(F.col(f"__{out}_w") > 0, arr).alias(out))
    return g.select(*cols)


def cls_pool(tokens: DataFrame, *, keys=("sent_id", "layer"), pos: str = "pos",
             vec: str = "vec") -> DataFrame:
    """First-token pooling: the vector at position 0 (a filter, no shuffle)."""
    return tokens.filter(F.col(pos) == 0).select(*keys, F.col(vec).alias("pooled"))
