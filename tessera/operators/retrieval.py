"""Exact nearest-neighbour sentence retrieval and Acc@k.

Direction follows the evaluation convention: distances are laid out
``[source, target]`` and sorted per target, so the *target* row is the
query and its neighbours are *source* rows; the gold neighbour of target
``i`` is source ``i``.

Physical plan of :func:`topk_neighbours` (no cross join, no all-pairs
output):

1. both sides get a block id by the hash of the row key: ``X`` source and
   ``Y`` query blocks, counted for every group (language) on its own;
2. every source row is replicated to the ``Y`` query blocks and every
   query row to the ``X`` source blocks (``explode(sequence)``, a narrow
   operator), so block pair ``(xb, yb)`` holds ~N/X sources and ~M/Y
   queries — shuffle volume (Y·N + X·M)·d instead of N·M;
3. ``groupBy(xb, yb).applyInPandas`` runs BLAS products over tiles of a block
   pair (:class:`BlockSearch`) and keeps, per query, the local top-k under the
   total order ``(round(dist, 9), source idx)``;
4. the ≤ X·k candidates per query are merged by a window partitioned by
   the query key (bounded per key, so no hot partition).

``X`` and ``Y`` are chosen so one block holds about ``BLOCK_BYTES`` of vectors (or
``block_rows`` of them); group memory is therefore bounded whatever the input size,
and a row is copied once per ``BLOCK_BYTES`` of the other side.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import l2_distance, l2_normalize


BLOCK_BYTES = 32 << 20          # vectors of a block, in double precision


def block_rows_of(dimension: Column) -> Column:
    """Rows of a block of about ``BLOCK_BYTES``, for a column of dimensions."""
    return F.greatest(F.floor(F.lit(float(BLOCK_BYTES)) / (8 * F.greatest(dimension, F.lit(1)))), F.lit(1))


def least_blocks(spark) -> int:
    """Enough block pairs to keep every core busy on small inputs."""
    return int(math.ceil(math.sqrt(spark.sparkContext.defaultParallelism)))


def normalize(df: DataFrame, vec: str = "vec", out: str | None = None) -> DataFrame:
    """L2-normalise a vector column (zero vectors become null)."""
    return df.withColumn(out or vec, l2_normalize(vec))


def _with_blocks(queries: DataFrame, sources: DataFrame, group_cols: list[str], vec: str, block_rows: int | None,
                 min_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__xn`` source blocks and ``__yn`` query blocks.

    Without groups these are two counts; with groups every group gets its own
    (one row per group, a partial aggregate of each side), so a small group is
    not cut into the blocks that the largest one needs."""
    def blocks(n):
        rows = F.lit(block_rows) if block_rows else block_rows_of(F.max("dim"))
        return F.greatest(F.ceil(n / rows), F.lit(min_blocks)).cast("int")
    sides = [df.select(*[F.col(g).alias(f"__{g}") for g in group_cols], F.lit(x).alias("x"), F.lit(1 - x).alias("y"), F.size(vec).alias("dim"))
             for df, x in ((sources, 1), (queries, 0))]
    sizes = sides[0].unionByName(sides[1]).groupBy(*[f"__{g}" for g in group_cols]).agg(blocks(F.sum("x")).alias("__xn"), blocks(F.sum("y")).alias("__yn"))
    if not group_cols:
        xn, yn = sizes.first()
        return tuple(df.withColumns({"__xn": F.lit(xn), "__yn": F.lit(yn)}) for df in (queries, sources))
    def sized(df):
        on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group_cols]
        return df.join(sizes, on).drop(*[f"__{g}" for g in group_cols])
    return sized(queries), sized(sources)


def _first_of_equal(X: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows in order of id, without those that have ``k`` equal vectors before
    them: copies are at one distance, so ties leave them out of any first k."""
    order = np.argsort(ids, kind="stable")
    if len(ids) <= k or not X.shape[1]:
        return order
    bits = np.ascontiguousarray(X).view(np.uint64)
    code = (bits * (np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(axis=1, dtype=np.uint64)[order]
    by = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.r_[True, code[by][1:] != code[by][:-1]])
    size = np.diff(np.r_[starts, len(by)])
    if size.max() <= k:
        return order
    head, rank = np.repeat(starts, size), np.arange(len(by))
    rank = rank - head
    many = np.flatnonzero(np.repeat(size, size) > k)
    differs = many[(bits[order[by[many]]] != bits[order[by[head[many]]]]).any(axis=1)]
    drop = (rank >= k) & ~np.isin(head, head[differs])             # other vectors of the same code: all stay
    keep = np.ones(len(order), bool)
    keep[by[drop]] = False
    return order[keep]


def _set_places(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask with few set places, eight bytes at a time."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    near = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


class BlockSearch:
    """The first ``k`` of a block of sources for tiles of queries, in the total
    order ``(round(dist, 9), id)``.

    A product of single precision, with a bound on its error, leaves out what is
    surely beyond the k-th distance seen so far; the few rows that are left get
    their distance in the direct form with a sequential sum, which is bit-equal to
    the JVM ``aggregate(zip_with(...))``. Where single precision cannot tell the
    neighbours of a query from the rest (vectors far from the origin, say), the product is
    of double precision. What is not a number is never left out."""

    TILE, COLUMNS = 512, 4096

    def __init__(self, ids: np.ndarray, X: np.ndarray, k: int, copies: bool = False):
        """``copies`` keeps equal vectors that no first ``k`` of the block needs."""
        self.k = k
        rows = np.argsort(ids, kind="stable") if copies else _first_of_equal(X, ids, k)
        self.kept, self.X, self.ids = rows, np.ascontiguousarray(X[rows]), ids[rows]
        self.half = np.einsum("ij,ij->i", self.X, self.X) / 2
        self.most = float(self.half.max()) if len(rows) else 0.0   # nan and inf make the margin so, and then nothing is left out
        self.form = None

    def _margin(self, y2: np.ndarray, dtype) -> np.ndarray:
        """Bound on the error of a product of ``dtype``, summed in any order."""
        u = np.finfo(dtype).eps
        return (self.X.shape[1] + 8) * u * (np.sqrt(2 * self.most * y2) + self.most) + 1e-30

    def _choose(self, Y: np.ndarray):
        some = np.linspace(0, len(self.X) - 1, min(len(self.X), 1024)).astype(int)
        ask = Y[np.linspace(0, len(Y) - 1, min(len(Y), 128)).astype(int)]
        s = self.half[some][None, :] - ask @ self.X[some].T
        kth = np.partition(s, min(self.k, len(some)) - 1, axis=1)[:, min(self.k, len(some)) - 1]
        unsure = (s <= (kth + 4 * self._margin(np.einsum("ij,ij->i", ask, ask), np.float32))[:, None]).sum(axis=1).mean()
        dtype = np.float32 if unsure <= 2 * self.k + 32 else np.float64
        self.form = np.concatenate([-self.X, self.half[:, None]], axis=1).astype(dtype)

    def _exact(self, Y, row, col):
        """Of each row the first ``k`` of its pairs, with their distance."""
        dist = np.empty(len(row))
        for s in range(0, len(row), 16384):
            diff = self.X[col[s:s + 16384]] - Y[row[s:s + 16384]]
            dist[s:s + 16384] = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
        order = np.lexsort((self.ids[col], np.round(dist, 9), row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[rank < self.k]
        return order, dist[order]

    def tile(self, Y: np.ndarray, columns: np.ndarray | None = None, bound: np.ndarray | None = None):
        """``(row, id, dist)`` for queries ``Y`` against the sources at
        ``columns`` (all if None); ``bound`` is a distance beyond which a source
        is of no use, or nan."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._tile(Y, columns, bound)

    def _tile(self, Y, columns, bound):
        n = len(self.X) if columns is None else len(columns)
        none = np.zeros(0, np.int64)
        if not n or not len(Y):
            return none, none, np.zeros(0)
        if self.form is None:
            self._choose(Y)
        y2 = np.einsum("ij,ij->i", Y, Y)
        err = self._margin(y2, self.form.dtype)
        ask = np.concatenate([Y, np.ones((len(Y), 1))], axis=1).astype(self.form.dtype)

        def limit(kth):
            """Covers two errors and the distances that round to the k-th."""
            value = kth + 2 * err + 1e-7 * (1.0 + np.abs(2 * kth + y2))
            return np.nextafter(value.astype(ask.dtype), ask.dtype.type(np.inf))

        most = np.full(len(Y), np.inf)
        if bound is not None:
            most = np.where(np.isnan(bound), np.inf, (bound * bound - y2) / 2)
        top = limit(most)
        row, col, val = none, none, np.zeros(0, ask.dtype)
        at, width, told = 0, 1024, 0
        while at < n:
            stop = min(n, at + width)
            part = slice(at, stop) if columns is None else columns[at:stop]
            s = ask @ self.form[part].T
            if at == 0 and stop - at >= self.k and np.isinf(most).any():
                first = np.partition(s, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                most = np.fmin(most, first) if not np.isnan(first).any() else most
                top = limit(most)
            hit = _set_places(~(s > top[:, None]))
            r, c = np.divmod(hit, stop - at)
            row, val = np.concatenate([row, r]), np.concatenate([val, s.ravel()[hit]])
            col = np.concatenate([col, c + at if columns is None else columns[c + at]])
            at, width = stop, min(2 * width, self.COLUMNS)
            if at < n and len(row) - told > self.k * len(Y) // 2:
                order = np.lexsort((val, row))
                row, col, val = row[order], col[order], val[order]
                start = np.searchsorted(row, np.arange(len(Y)))
                full = np.flatnonzero(np.searchsorted(row, np.arange(len(Y)), side="right") - start >= self.k)
                seen = val[start[full] + self.k - 1].astype(np.float64)
                most[full] = np.where(np.isnan(seen), most[full], np.minimum(most[full], seen))
                top = limit(most)
                keep = ~(val > top[row])
                row, col, val = row[keep], col[keep], val[keep]
                if len(row) > 128 * len(Y):                        # very many at one distance
                    order, _ = self._exact(Y, row, col)
                    row, col, val = row[order], col[order], val[order]
                told = len(row)
        keep = ~(val > top[row])
        row, col = row[keep], col[keep]
        order, dist = self._exact(Y, row, col)
        return row[order], self.ids[col[order]], dist

    def run(self, ids: np.ndarray, Y: np.ndarray) -> pd.DataFrame:
        """``query_idx, neighbour_idx, dist, dist9`` of all queries against all sources."""
        parts = []
        for s in range(0, len(ids), self.TILE):
            row, found, dist = self.tile(Y[s:s + self.TILE])
            parts.append((ids[s + row], found, dist))
        return found_rows(parts)


def found_rows(parts: list) -> pd.DataFrame:
    q, n, d = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"query_idx": q, "neighbour_idx": n, "dist": d, "dist9": np.round(d, 9)})


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _local_topk_fn(k: int, group_cols: list[str]):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        xs = pdf[pdf["side"] == 0]
        ys = pdf[pdf["side"] == 1]
        cols = group_cols + ["query_idx", "neighbour_idx", "dist", "dist9"]
        if len(xs) == 0 or len(ys) == 0:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in cols})
        search = BlockSearch(xs["idx"].to_numpy(dtype=np.int64), stacked(xs["vec"]), k)
        res = search.run(ys["idx"].to_numpy(dtype=np.int64), stacked(ys["vec"]))
        for g in group_cols:
            res.insert(0, g, pdf[g].iloc[0])
        return res[cols]
    return fn


def topk_neighbours(queries: DataFrame, sources: DataFrame, k: int = 10, *,
                    key: str = "idx", vec: str = "vec", group_cols: list[str] | None = None,
                    block_rows: int | None = None, min_blocks: int | None = None) -> DataFrame:
    """Exact k nearest ``sources`` rows (Euclidean) for every ``queries`` row.

    Returns ``group_cols + (query_idx, rank, neighbour_idx, distance)`` with
    ``rank`` 1-based, ties broken by the lower source index and
    ``distance`` rounded to 6 places. Normalise both sides first for the
    cosine mode.
    """
    group_cols = list(group_cols or [])
    spark = queries.sparkSession
    # a zero vector has no direction (null after normalising) and no neighbours
    queries, sources = queries.filter(F.col(vec).isNotNull()), sources.filter(F.col(vec).isNotNull())
    if min_blocks is None:
        min_blocks = least_blocks(spark)
    gfields = [queries.schema[g] for g in group_cols]
    queries, sources = _with_blocks(queries, sources, group_cols, vec, block_rows, min_blocks)

    def prep(df, side):
        base = df.select(*group_cols, F.col(key).cast("long").alias("idx"),
                         F.col(vec).cast("array<double>").alias("vec"), "__xn", "__yn")
        own, others = ("__xn", "__yn") if side == 0 else ("__yn", "__xn")
        mine = F.pmod(F.xxhash64("idx"), F.col(own)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        xb, yb = (mine, other) if side == 0 else (other, mine)
        return base.select(*group_cols, "idx", "vec", xb.alias("xb"), yb.alias("yb"), F.lit(side).alias("side"))

    both = prep(sources, 0).unionByName(prep(queries, 1))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in gfields]
        + [T.StructField("query_idx", T.LongType()), T.StructField("neighbour_idx", T.LongType()),
           T.StructField("dist", T.DoubleType()), T.StructField("dist9", T.DoubleType())])
    local = both.groupBy(*group_cols, "xb", "yb").applyInPandas(_local_topk_fn(k, group_cols), schema)
    w = Window.partitionBy(*group_cols, "query_idx").orderBy("dist9", "neighbour_idx")
    return (local.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(*group_cols, "query_idx", F.col("rank").cast("int").alias("rank"),
                    "neighbour_idx", F.round("dist", 6).alias("distance")))


def write_source_index(sources: DataFrame, path: str, *, key: str = "idx", vec: str = "vec", block_rows: int = 4096) -> DataFrame:
    """Sources written once as a table bucketed by block (``block, idx, vec``;
    about ``block_rows`` rows per block), which later searches read without an
    exchange. ``path`` is a folder in shared storage; vectors that are null are
    left out."""
    spark = sources.sparkSession
    rows = sources.filter(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("idx"), F.col(vec).cast("array<double>").alias("vec"))
    blocks = max(1, math.ceil(rows.count() / block_rows))          # ids 0 to blocks - 1
    name = "source_index_" + uuid.uuid4().hex[:12]
    rows.withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")).repartition(blocks, "block") \
        .write.bucketBy(blocks, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def topk_indexed(queries: DataFrame, index: DataFrame, k: int = 10, *, key: str = "idx", vec: str = "vec") -> DataFrame:
    """The rows of :func:`topk_neighbours` (without groups) against a source
    index: queries are copied to the blocks, the sources stay where they are.
    The caller bounds the queries of one call (a micro-batch)."""
    last = index.agg(F.max("block")).first()[0]
    asked = queries.filter(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("idx"), F.col(vec).cast("array<double>").alias("vec"))
    spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    search = _local_topk_fn(k, [])

    def met(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return search(pd.concat([mine.assign(side=0), theirs.assign(side=1)], ignore_index=True))

    local = index.groupBy("block").cogroup(spread.groupBy("block")).applyInPandas(
        met, "query_idx long, neighbour_idx long, dist double, dist9 double")
    w = Window.partitionBy("query_idx").orderBy("dist9", "neighbour_idx")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
                .select("query_idx", F.col("rank").cast("int").alias("rank"), "neighbour_idx", F.round("dist", 6).alias("distance"))


def topk_neighbours_sql(queries: DataFrame, sources: DataFrame, k: int = 10, *,
                        key: str = "idx", vec: str = "vec",
                        group_cols: list[str] | None = None) -> DataFrame:
    """Reference form: every pair's distance, then a per-query window.

    Quadratic rows; kept for small inputs and for cross-checking
    :func:`topk_neighbours`, never used by the registered queries.
    """
    group_cols = list(group_cols or [])
    q = queries.select(*group_cols, F.col(key).alias("query_idx"), F.col(vec).alias("qv"))
    s = sources.select(*group_cols, F.col(key).alias("neighbour_idx"), F.col(vec).alias("sv"))
    pairs = q.join(s, on=group_cols, how="inner") if group_cols else q.crossJoin(s)
    d = pairs.select(*group_cols, "query_idx", "neighbour_idx", l2_distance("qv", "sv").alias("dist"))
    w = Window.partitionBy(*group_cols, "query_idx").orderBy(F.round("dist", 9), "neighbour_idx")
    return (d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*group_cols, "query_idx", F.col("rank").cast("int").alias("rank"),
                    "neighbour_idx", F.round("dist", 6).alias("distance")))


def gold_distance(queries: DataFrame, sources: DataFrame, *, key: str = "idx", vec: str = "vec",
                  group_cols: list[str] | None = None) -> DataFrame:
    """Distance of every query to its gold source (aligned by row index)."""
    group_cols = list(group_cols or [])
    q = queries.select(*group_cols, F.col(key).alias("idx"), F.col(vec).alias("qv"))
    s = sources.select(*group_cols, F.col(key).alias("idx"), F.col(vec).alias("sv"))
    return (q.join(s, on=group_cols + ["idx"], how="inner")
            .select(*group_cols, "idx", F.round(l2_distance("qv", "sv"), 6).alias("distance")))


def retrieval_acc(neighbours: DataFrame, queries: DataFrame, *, key: str = "idx",
                  group_cols: list[str] | None = None, ks=(1, 5, 10)) -> DataFrame:
    """Acc@k: share of queries whose own index is among their first k
    neighbours. The denominator is the number of query (target) rows."""
    group_cols = list(group_cols or [])
    hits = (neighbours.filter(F.col("query_idx") == F.col("neighbour_idx"))
            .groupBy(*group_cols, "query_idx").agg(F.min("rank").alias("gold_rank")))
    q = queries.select(*group_cols, F.col(key).alias("query_idx"))
    j = q.join(hits, on=group_cols + ["query_idx"], how="left")
    aggs = [F.round(F.avg(F.when(F.col("gold_rank") <= kk, 1.0).otherwise(0.0)), 6).alias(f"acc{kk}")
            for kk in ks]
    aggs.append(F.count(F.lit(1)).alias("n_queries"))
    return j.groupBy(*group_cols).agg(*aggs)


def layer_select(df: DataFrame, total_layers: int, num_layers: int, index: int,
                 layer_col: str = "layer") -> DataFrame:
    """Keep the layer at ``index`` of the last ``num_layers`` of ``total_layers``
    hidden states (index 7 of the last 12 of 13 is absolute layer 8). On a
    table partitioned by layer this prunes partitions at the scan."""
    absolute = total_layers - num_layers + index
    return df.filter(F.col(layer_col) == F.lit(absolute))
