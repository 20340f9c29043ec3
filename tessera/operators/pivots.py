"""Exact nearest neighbours with pivots and the triangle inequality.

Sources are clustered around pivots (rows of smallest hash, at most
``MOST_PIVOTS`` per group), and a cluster is cut into cells by the distance to
its pivot; large cells are dealt over parts, so a cell has a bounded number of
rows and a known interval of distances. Cells lie on shelves, each about as many
rows as a block of :func:`topk_neighbours`.

A query first searches one cell, the one of its nearest pivot whose interval is
nearest; the k-th distance found there bounds the answer. It then visits a cell
only if the cell can hold a source that near:

* ``d(q, s) >= max(low - d(q, p), d(q, p) - high)`` for a cell of pivot ``p``
  with distances in ``[low, high]``;
* ``d(q, s) >= (d(q, p)^2 - d(q, p')^2) / (2 d(p, p'))`` for the pivot ``p'``
  nearest to the query, since ``s`` is nearer to ``p`` than to ``p'``.

Both bounds are exact, so the result is that of :func:`topk_neighbours`, ties
included. How much they leave out depends on the vectors: clustered ones prune
well, directions drawn at random in many dimensions hardly at all. A query is
therefore sent once to a shelf, with a bit for each cell it visits there: where the
bounds leave nothing out, copies are as many as those of the block search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.retrieval import BlockSearch, block_rows_of, found_rows, least_blocks, stacked
from tessera.session import stage_table

MOST_PIVOTS = 256
LOT_ROWS = 4096         # rows that meet the pivots at once
SLACK = 1e-6            # covers the rounding of the product form of a distance, per unit of the lengths


def _distances(rows: pd.Series, pivots: np.ndarray) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _side(df: DataFrame, group_cols: list[str], key: str, vec: str, block_rows: int) -> DataFrame:
    """``group_cols, idx, vec, salt``: the rows of a group dealt over lots of
    about ``block_rows``."""
    base = df.filter(F.col(vec).isNotNull()).select(*group_cols, F.col(key).cast("long").alias("idx"), F.col(vec).cast("array<double>").alias("vec"))
    base = _with_group(base, group_cols)
    lots = base.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("lots"))
    return base.join(lots, "grp").withColumn("salt", F.pmod(F.xxhash64("idx", F.lit(5)), F.col("lots")))


def _with_group(df: DataFrame, group_cols: list[str]) -> DataFrame:
    """One key for all group columns; nulls are a group like any other."""
    return df.withColumn("grp", F.to_json(F.struct(*group_cols)) if group_cols else F.lit(""))


def _pivots(sources: DataFrame, block_rows: int) -> DataFrame:
    """``grp, pid, vec``: one pivot per ``block_rows`` sources of a group, at
    least one, at most ``MOST_PIVOTS``."""
    size = sources.groupBy("grp").agg(F.least(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(MOST_PIVOTS)).alias("want"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64("idx", F.lit(11)), "idx", "vec")
    first = sources.withColumn("pid", F.row_number().over(order)).filter(F.col("pid") <= MOST_PIVOTS)
    return first.join(size, "grp").filter(F.col("pid") <= F.col("want")).select("grp", "pid", F.col("vec").alias("pivot"))


def _meet_pivots(side: DataFrame, pivots: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows, pivots)`` for every lot of a group with the group's pivots."""
    lots = side.select("grp", "lots").distinct().select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("salt"))
    own = pivots.join(lots, "grp")
    return side.drop("lots").groupBy("grp", "salt").cogroup(own.groupBy("grp", "salt")).applyInPandas(fn, schema)


def _plain(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=object, na_value=None)


def _nearest(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(pivots):
        return pd.DataFrame({c: pd.Series(dtype=object) for c in ("grp", "idx", "vec", "pid", "dist")})
    pivots = pivots.sort_values("pid")
    d = _distances(rows["vec"], np.stack(pivots["pivot"].to_numpy()))
    at = d.argmin(axis=1)
    return pd.DataFrame({"grp": _plain(rows["grp"]), "idx": rows["idx"].to_numpy(), "vec": rows["vec"].to_numpy(), "pid": pivots["pid"].to_numpy()[at],
                         "dist": d[np.arange(len(d)), at]})


class _Cells:
    """The pivots of a group and, as flat arrays, their cells in order of shelf and place."""

    def __init__(self, pivots: pd.DataFrame):
        pivots = pivots.sort_values("pid")
        self.pivots = stacked(pivots["pivot"])
        size = np.array([len(x) for x in pivots["shelf"]])
        shelf, at, low, high, n = (np.concatenate(pivots[c].to_numpy()) for c in ("shelf", "at", "low", "high", "n"))
        order = np.lexsort((at, shelf))
        self.owner = np.repeat(np.arange(len(size)), size)[order]
        self.shelf, self.low, self.high, self.n = (x[order] for x in (shelf, low, high, n))
        starts = np.flatnonzero(np.r_[True, self.shelf[1:] != self.shelf[:-1]])
        self.span = list(zip(self.shelf[starts], starts, np.r_[starts[1:], len(self.shelf)]))
        self.longest = np.sqrt((self.pivots ** 2).sum(axis=1)).max() + self.high.max()

    def gaps(self, d: np.ndarray) -> np.ndarray:
        """Least distance to a source of each cell, from distances to the pivots."""
        d = d[:, self.owner]
        return np.maximum(np.maximum(self.low - d, d - self.high), 0.0)


_VISIT = "grp string, shelf long, near int, idx long, vec array<double>, kth double, cells binary"


def _sent(rows: pd.DataFrame, cells: _Cells, near: np.ndarray, kth: np.ndarray, visits: np.ndarray) -> pd.DataFrame:
    """A row per query and shelf with a cell to visit; ``cells`` has a bit for each
    cell of the shelf."""
    out = []
    for shelf, start, stop in cells.span:
        some = np.flatnonzero(visits[:, start:stop].any(axis=1))
        bits = np.packbits(visits[some, start:stop], axis=1, bitorder="little")
        out.append(pd.DataFrame({"grp": _plain(rows["grp"])[some], "shelf": np.full(len(some), shelf), "near": near[some], "idx": rows["idx"].to_numpy()[some],
                                 "vec": rows["vec"].to_numpy()[some], "kth": kth[some], "cells": pd.Series([b.tobytes() for b in bits], dtype=object)}))
    return pd.concat(out, ignore_index=True)


def _none_sent() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in _VISIT.split(", ")})


def _home(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Every query with one cell of its nearest pivot: the nearest, of equal ones the largest."""
    if not len(rows) or not len(pivots):
        return _none_sent()
    cells = _Cells(pivots)
    d = _distances(rows["vec"], cells.pivots)
    near = d.argmin(axis=1)
    visits = np.zeros((len(rows), len(cells.shelf)), bool)
    for p in np.unique(near):
        mine, own = np.flatnonzero(near == p), np.flatnonzero(cells.owner == p)
        own = own[np.argsort(-cells.n[own], kind="stable")]
        x = d[mine, p][:, None]
        gap = np.maximum(np.maximum(cells.low[own] - x, x - cells.high[own]), 0.0)
        visits[mine, own[gap.argmin(axis=1)]] = True
    return _sent(rows, cells, near, np.full(len(rows), np.nan), visits)


def _possible(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Every query with the cells that both bounds leave."""
    if not len(rows) or not len(pivots):
        return _none_sent()
    cells = _Cells(pivots)
    between = _distances(pivots.sort_values("pid")["pivot"], cells.pivots)
    out = []
    for s in range(0, len(rows), 512):
        some = rows.iloc[s:s + 512]
        d = _distances(some["vec"], cells.pivots)
        near = d.argmin(axis=1)
        least = d[np.arange(len(d)), near]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(between[near] > 0, (d ** 2 - (least ** 2)[:, None]) / (2 * between[near]), 0.0)
        kth = some["kth"].to_numpy(dtype=np.float64)
        length = np.sqrt((stacked(some["vec"]) ** 2).sum(axis=1))
        limit = (np.where(np.isnan(kth), np.inf, kth) + SLACK * (1 + length + cells.longest))[:, None]
        out.append(_sent(some, cells, near, kth, ~(bound > limit)[:, cells.owner] & ~(cells.gaps(d) > limit)))
    return pd.concat(out, ignore_index=True)


def cells_of(sources: DataFrame, pivots: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Sources with their ``cell`` (a pivot, a ring of distances, a part), and
    the table of cells with their size and interval."""
    placed = stage_table(_meet_pivots(sources.select("grp", "salt", "idx", "vec", "lots"), pivots, _nearest,
                                      "grp string, idx long, vec array<double>, pid int, dist double"), "pivot-sources")
    span = placed.groupBy("grp", "pid").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.ceil(F.count(F.lit(1)) / block_rows).alias("rings"))
    width = F.when(F.col("high") > F.col("low"), (F.col("dist") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    ringed = placed.join(span, ["grp", "pid"]).withColumn("ring", F.least(F.floor(width * F.col("rings")), F.col("rings") - 1)) \
                   .select("grp", "pid", "ring", "idx", "vec", "dist")
    full = ringed.groupBy("grp", "pid", "ring").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64("idx", F.lit(7)), F.col("parts"))
    celled = ringed.join(full, ["grp", "pid", "ring"]).withColumn("cell", F.concat_ws("-", "pid", "ring", part)).select("grp", "pid", "cell", "idx", "vec", "dist")
    celled = stage_table(celled, "pivot-cells")
    table = celled.groupBy("grp", "pid", "cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
    return celled, _shelved(table, block_rows, least_blocks(sources.sparkSession))


def _shelved(table: DataFrame, block_rows: int, min_blocks: int) -> DataFrame:
    """The table of cells with the ``shelf`` of each and its place ``at`` there. A
    row of this table stands for a cell, so the running sum is over few rows."""
    whole = Window.partitionBy("grp")
    running = whole.orderBy("pid", "cell").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.least(block_rows_of(F.max("dim").over(whole)), F.ceil(F.sum("n").over(whole) / min_blocks))
    shelf = F.floor(F.coalesce(F.sum("n").over(running), F.lit(0)) / F.greatest(rows, F.lit(block_rows)))
    return table.withColumn("shelf", shelf.cast("long")).withColumn("at", F.row_number().over(Window.partitionBy("grp", "shelf").orderBy("pid", "cell")) - 1).drop("dim")


def _shelf_search(k: int, copies: bool):
    """Local top k of every query of a shelf in (at least) the cells it visits."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(xs) or not len(ys):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("grp", "query_idx", "neighbour_idx", "dist", "dist9")})
        search = BlockSearch(xs["idx"].to_numpy(dtype=np.int64), stacked(xs["vec"]), k, copies)
        at = xs["at"].to_numpy(dtype=np.int64)[search.kept]
        ys = ys.sort_values(["near", "cells"], kind="stable")       # queries of one tile visit much the same cells
        ids, kth = ys["idx"].to_numpy(dtype=np.int64), ys["kth"].to_numpy(dtype=np.float64)
        Y, parts = stacked(ys["vec"]), []
        bits = np.frombuffer(b"".join(ys["cells"]), np.uint8).reshape(len(ys), -1)
        for s in range(0, len(ys), search.TILE):
            part = slice(s, s + search.TILE)
            cells = np.unpackbits(np.bitwise_or.reduce(bits[part], axis=0), bitorder="little").astype(bool)
            wanted = cells[at]
            row, found, dist = search.tile(Y[part], None if wanted.all() else np.flatnonzero(wanted), kth[part])
            parts.append((ids[s + row], found, dist))
        res = found_rows(parts)
        res.insert(0, "grp", pdf["grp"].iloc[0])
        return res
    return fn


def _met(asked: DataFrame, celled: DataFrame, cells: DataFrame, k: int, block_rows: int, copies: bool = False) -> DataFrame:
    """Local top k of every query on every shelf it is sent to. Many queries of one
    shelf are dealt over blocks, and only then is the shelf copied."""
    rows = F.greatest(block_rows_of(F.max(F.size("vec"))), F.lit(block_rows))
    blocks = asked.groupBy("grp", "shelf").agg(F.ceil(F.count(F.lit(1)) / F.least(rows, F.greatest(F.lit(LOT_ROWS), F.ceil(F.count(F.lit(1)) / least_blocks(asked.sparkSession))))).alias("blocks"))
    mine = asked.join(blocks, ["grp", "shelf"]).select("grp", "shelf", F.pmod(F.xxhash64("idx", F.lit(9)), F.col("blocks")).alias("block"), "idx", "vec",
                                                       "near", "kth", "cells", F.lit(None).cast("int").alias("at"), F.lit(1).alias("side"))
    placed = celled.join(cells.select("grp", "cell", "shelf", "at"), ["grp", "cell"])
    theirs = placed.join(blocks, ["grp", "shelf"]).select(
        "grp", "shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "idx", "vec",
        F.lit(None).cast("int").alias("near"), F.lit(None).cast("double").alias("kth"), F.lit(None).cast("binary").alias("cells"), "at", F.lit(0).alias("side"))
    return mine.unionByName(theirs).groupBy("grp", "shelf", "block").applyInPandas(
        _shelf_search(k, copies), "grp string, query_idx long, neighbour_idx long, dist double, dist9 double")


def _sent_queries(queries: DataFrame, sources: DataFrame, k: int, key: str, vec: str, group_cols: list[str],
                  block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(kths, sent, cells, celled)``: the k-th distance in the first cell, a row
    per query and shelf it has to visit, the table of cells and the sources in them."""
    lot = max(block_rows, LOT_ROWS)
    src = stage_table(_side(sources, group_cols, key, vec, lot), "pivot-src")
    ask = stage_table(_side(queries, group_cols, key, vec, lot), "pivot-ask")
    pivots = stage_table(_pivots(src, block_rows), "pivots")
    celled, cells = cells_of(src, pivots, block_rows)
    cells = stage_table(cells, "pivot-table")
    listed = cells.groupBy("grp", "pid").agg(F.collect_list(F.struct("shelf", "at", "low", "high", "n")).alias("c"))
    about = stage_table(pivots.join(listed, ["grp", "pid"]).select("grp", "pid", "pivot", *[F.col(f"c.{x}").alias(x) for x in ("shelf", "at", "low", "high", "n")]), "pivot-about")
    home = stage_table(_meet_pivots(ask, about, _home, _VISIT), "pivot-home")
    first = _met(home, celled, cells, k, block_rows, copies=True)
    kths = stage_table(first.groupBy("grp", "query_idx").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("kth")).withColumnRenamed("query_idx", "idx"), "pivot-first")
    sent = stage_table(_meet_pivots(ask.join(kths, ["grp", "idx"], "left"), about, _possible, _VISIT), "pivot-visits")
    return kths, sent, cells, celled


def planned_visits(queries: DataFrame, sources: DataFrame, k: int = 10, *, key: str = "idx", vec: str = "vec",
                   group_cols: list[str] | None = None, block_rows: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(first, visits, cells, celled)``: the k-th distance in the first cell, the
    ``(grp, cell, idx)`` each query has to visit, the table of cells and the
    sources in them."""
    first, sent, cells, celled = _sent_queries(queries, sources, k, key, vec, list(group_cols or []), block_rows)
    byte = F.conv(F.hex(F.substring("cells", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod("at", F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    visits = sent.join(cells.select("grp", "shelf", "at", "cell"), ["grp", "shelf"]).filter(bit == 1).select("grp", "cell", "idx")
    return first, visits, cells, celled


def topk_pruned(queries: DataFrame, sources: DataFrame, k: int = 10, *, key: str = "idx", vec: str = "vec",
                group_cols: list[str] | None = None, block_rows: int = 4096) -> DataFrame:
    """Exact k nearest ``sources`` rows (Euclidean) for every ``queries`` row,
    with the columns, ties and rounding of :func:`topk_neighbours`. Query keys
    are distinct within a group."""
    group_cols = list(group_cols or [])
    _, sent, cells, celled = _sent_queries(queries, sources, k, key, vec, group_cols, block_rows)
    found = _met(sent, celled, cells, k, block_rows)
    order = Window.partitionBy("grp", "query_idx").orderBy("dist9", "neighbour_idx")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = T.StructType([T.StructField(g, queries.schema[g].dataType) for g in group_cols])
    groups = [F.from_json("grp", named).getField(g).alias(g) for g in group_cols]
    return ranked.select(*groups, "query_idx", F.col("rank").cast("int").alias("rank"), "neighbour_idx", F.round("dist", 6).alias("distance"))
