"""Operator 1, SimHash near-dedup: BK-trees over fingerprints.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed
42) of the text's word shingles. Two documents link when their fingerprints
differ in at most ``radius`` bits; classes are the connected components.

Search: only distinct fingerprints are searched. The 64 bits are cut into
``radius + 2`` blocks; two fingerprints within the radius agree on at least
two of them, so every pair of blocks is a shard key and one shard holds both.
A shard's fingerprints form a BK-tree (children keyed by Hamming distance to
the parent) that answers its own members, following only edges within the
radius of the distance found. A shard of more than ``TREE`` fingerprints is
dealt over numbered parts, and every pair of parts is a tree of its own, so no
task holds more than two parts; no partner is dropped. The trees travel with
the shuffle to the task that queries them instead of being broadcast, since
their number follows the input. Each tree returns its members joined to the
smallest linked one, never all pairs.

Defined cases: texts without a word (null, empty) have fingerprint zero and
link like any other; fewer words than a shingle give one shingle; equal texts
have equal fingerprints; null ids never name a class that has another id;
repeated rows share a class, and ``near_dedup`` keeps one of them; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import own_names, stage
from tessera.llm.components import connected_components

BITS = 64
TREE = 8192


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()          # bytes: A-Z and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, 42) for p in parts], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(shingle: int = 3):
    """Column function: the fingerprint as a signed long."""
    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        values = [fingerprint_of(t.as_buffer().to_pybytes(), shingle) for t in texts.cast(pa.binary())]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))
    return of


# --- BK-trees --------------------------------------------------------------

def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree per group, built and searched level by level. ``group``
    numbers rise; the values of a group are distinct."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        first = np.concatenate([[True], group[1:] != group[:-1]])
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        at, left, edges, to = self.root.copy(), np.flatnonzero(~first), [], []
        while len(left):
            key = at[left] * (BITS + 1) + _distance(value[left], value[at[left]])
            u, one, inv = np.unique(key, return_index=True, return_inverse=True)
            child = left[one]
            edges.append(u)
            to.append(child)
            at[left] = child[inv]
            stays = np.ones(len(left), bool)
            stays[one] = False
            left = left[stays]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.to = np.concatenate(to) if to else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.to = self.edges[order], self.to[order]

    def links(self, radius: int, block: int = 2048):
        """``(query, found)`` positions within the radius, in blocks."""
        for start in range(0, len(self.value), block):
            query = np.arange(start, min(start + block, len(self.value)))
            node = self.root[query]
            while len(query):
                d = _distance(self.value[query], self.value[node])
                near = (d <= radius) & (query != node)
                if near.any():
                    yield query[near], node[near]
                down_q, down_n = [], []
                for step in range(-radius, radius + 1):
                    want = node * (BITS + 1) + d + step
                    ok = (d + step > 0) & (d + step <= BITS)
                    at = np.searchsorted(self.edges, want)
                    at = np.minimum(at, max(0, len(self.edges) - 1))
                    hit = ok & (self.edges[at] == want) if len(self.edges) else np.zeros(len(want), bool)
                    down_q.append(query[hit])
                    down_n.append(self.to[at[hit]])
                query, node = np.concatenate(down_q), np.concatenate(down_n)


def _smallest_linked(size: int, pairs) -> np.ndarray:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (([p[0] for p in pairs]), ([p[1] for p in pairs])))
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(radius: int):
    def run(batches):
        def trees(key, tile, value):
            change = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            group = np.cumsum(change) - 1
            many = np.bincount(group)[group] > 1
            group, value = group[many], value[many]
            if not len(value):
                return None
            label = _smallest_linked(len(value), list(Forest(group, value.view(np.uint64)).links(radius)))
            linked = label != np.arange(len(value))
            if not linked.any():
                return None
            return pa.RecordBatch.from_arrays([pa.array(value[linked]), pa.array(value[label[linked]])], ["u", "v"])

        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0      # the last shard may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut and (out := trees(*(c[:cut] for c in cols))) is not None:
                yield out
        if held is not None and len(held[0]) and (out := trees(*held)) is not None:
            yield out
    return run


def links(values: DataFrame, radius: int = 2, tree: int = TREE) -> DataFrame:
    """Links ``(u, v)`` between the distinct fingerprints ``value``: enough to
    connect every two that are within the radius."""
    blocks = radius + 2
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def part(i):
        width = edge[i + 1] - edge[i]
        return F.shiftrightunsigned("value", edge[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.xxhash64(F.lit(i), F.lit(j), part(i), part(j)) for i in range(blocks) for j in range(i + 1, blocks)]
    keyed = values.select("value", F.explode(F.array(*keys)).alias("key"))
    full = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (tree // 2)).alias("parts")).filter("parts > 2")
    mine = F.pmod(F.xxhash64("value", F.lit(7)), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = keyed.join(full, "key", "left")
    normal = dealt.filter("parts is null").select("key", F.lit(-1).cast("long").alias("tile"), "value")
    split = dealt.filter("parts is not null").withColumn("mine", mine).withColumn("other", other) \
        .select("key", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("tile"), "value")
    tiles = normal.union(split)
    slots = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(slots, "key", "tile").sortWithinPartitions("key", "tile", "value") \
                .mapInArrow(_search(radius), "u long, v long").distinct()


def classes(rows: DataFrame, radius: int = 2, tree: int = TREE) -> DataFrame:
    """From staged ``(doc_id, text_hash, value)``: per fingerprint with more
    than one row or a link its ``component_id`` and the representing row
    ``(lead_id, lead_hash)``; all other fingerprints stand alone."""
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    values = rows.groupBy("value").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(links(values.select("value"), radius, tree)).withColumnRenamed("node", "value")
    joined = values.join(roots, "value", "left").filter("n > 1 or root is not null") \
                   .select("value", F.coalesce("root", "value").alias("root"), "lead")
    best = joined.groupBy("root").agg(F.min("lead").alias("lead"))
    return joined.select("value", "root").join(best, "root") \
                 .select("value", F.col("lead.doc_id").alias("component_id"), F.col("lead.doc_id").alias("lead_id"),
                         F.col("lead.text_hash").alias("lead_hash"))


def hashed_rows(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Staged ``(doc_id, text_hash, value)`` of every row, text read once."""
    text = F.coalesce("text", F.lit(""))
    return stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(shingle)(text).alias("value")), "simhash")


def near_classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``."""
    rows = hashed_rows(docs, shingle)
    found = classes(rows, radius).select("value", "component_id", F.lit(True).alias("known"))
    return rows.join(found, "value", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@own_names
def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that represent their class (smallest id, then
    smallest text hash): one row of each class."""
    rows = hashed_rows(docs, shingle)
    found = classes(rows, radius)
    same = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("text_hash") == F.col("lead_hash"))
    marked = rows.join(found, "value").groupBy("doc_id", "text_hash").agg(
        F.max(same).alias("keep"), F.count(F.lit(1)).alias("n")).filter("not keep or n > 1")
    marked = marked.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    joined = docs.join(marked, on, "left")
    lone = joined.filter("__keep is null")
    again = joined.filter("__keep").dropDuplicates(["__id", "__hash"])
    return lone.union(again).select(*docs.columns)
