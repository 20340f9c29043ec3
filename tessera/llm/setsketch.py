"""Operator 12, MinHash near-dedup with SetSketch registers.

A document's set is its distinct word shingles, as 64-bit hashes. Every shingle
deals points of a Poisson process to ``REGISTERS`` registers; a register keeps
its smallest point, stored as an exponent to base ``BASE`` in one byte. So
registers of a union are the maxima of the registers, and equal registers are
likely between similar sets. Equal sets are one row from here on.

Bands of ``ROWS`` registers, together with the size class, are bucket keys: at
the threshold a pair misses all bands with a chance below 1e-6. A pair of a
bucket goes on only if its registers, all taken together, leave a Jaccard
similarity at the threshold plausible: with the sizes known, the numbers of
larger, smaller and equal registers have a likelihood in the similarity, and
the pair is dropped where its maximum is more than ``EVIDENCE`` above that at
the threshold. What is left is verified on the full sets, read from the whole
texts of one row of each set.

No bucket emits all its pairs. First every member is compared with the
bucket's smallest member, and verified links become components. Buckets with
one component left are done, since any further link would add nothing. In the
others, members of different components are compared, in tiles of bounded size:
once by the likelihood, which tells the members that have a plausible partner,
and for these again with their sets, which gives at most one link per member.
Components of all verified links are the classes.

Defined cases: a null text is an empty one; texts without a word have no
shingle and stand alone; fewer words than a shingle give one shingle; a null id
names a class only where no row of it has an id; repeated rows share a class;
other columns, whatever their names, are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.components import connected_components
from tessera.llm.ngrams import slices, split_words

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, SHIFT = 1.2, 20        # register = floor(SHIFT - log_BASE(point)), 0 to 255
EVIDENCE = 10.0
TILE = 1 << 20               # shingles; the members of a bucket that a task holds at once have about two tiles of them
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xD1342543DE82EF95, 0x2545F4914F6CDD1D, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D,
                   0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


# --- sets and registers -----------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    offsets, index, distinct = split_words(pc.ascii_lower(texts), normal=False)
    words = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in distinct.cast(pa.binary())], dtype=np.uint64)
    full = pc.binary_length(distinct).to_numpy(zero_copy_only=False)[index] > 0        # white space at either end splits off an empty word
    words, offsets = words[index[full]], np.concatenate([[0], np.cumsum(full)])[offsets]
    count = len(words)
    whole = np.zeros(max(0, count - width + 1), np.uint64)
    for j in range(width):
        whole += words[j:count - width + 1 + j] * _PLACE[j]
    whole = _mix(whole + np.uint64(width))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:
            few = (words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], count: int = REGISTERS) -> np.ndarray:
    """One row of registers for each set; an empty set has only zeros."""
    least = np.full((len(sets), count), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    point, turn = np.zeros(len(element)), np.zeros(1, np.uint64)
    flat = least.reshape(-1)
    while len(element):
        turn += _STEP
        h = _mix(element + turn)
        gap = ((h >> np.uint64(24)).astype(np.float64) + 1.0) * 2.0 ** -40
        point = point - np.log(gap) / count
        slot = ((h & np.uint64(0xFFFFFF)) * np.uint64(count) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, owner * count + slot, point)
        live = point < least.max(axis=1)[owner]      # later points of a shingle are larger still
        element, owner, point = element[live], owner[live], point[live]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isinf(least), 0, np.clip(np.floor(SHIFT - np.log(least) / math.log(BASE)), 0, 255)).astype(np.uint8)


def _sketched(width: int, smallest: int):
    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                sets = shingle_sets(texts, width)
                key = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                marks = [b""] * len(sets)
                large = [i for i, s in enumerate(sets) if len(s) >= smallest]
                for i, row in zip(large, registers([sets[i] for i in large])):
                    marks[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(sets)), batch.column(1).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(key, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "marks"])
    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array(sets, pa.binary())], ["sid", "shingles"])
    return run


# --- likelihood -------------------------------------------------------------

def _log_likelihood(similarity, u, v, larger, smaller, equal):
    def p(x):
        return -np.log1p(-np.maximum(x, 0.0) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * similarity), p(v - u * similarity)
    tiny = 1e-12
    return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT, evidence: float = EVIDENCE) -> np.ndarray:
    """Whether the registers of each pair leave a similarity of ``percent`` or more plausible."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    total = (n_a + n_b).astype(np.float64)
    u, v = n_a / total, n_b / total
    most = np.minimum(u / v, v / u)
    fit = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    at = _log_likelihood(np.minimum(percent / 100, most), u, v, larger, smaller, equal)
    best = at.copy()
    for part in np.linspace(0, 1, 41):
        best = np.maximum(best, _log_likelihood(part * most, u, v, larger, smaller, equal))
    high = np.max([_log_likelihood(np.minimum(percent / 100, most) * (1 - s) + most * s, u, v, larger, smaller, equal) for s in (0.25, 0.5, 0.75, 1)], axis=0)
    return fit & (best - np.maximum(at, high) <= evidence)


def _rows(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary())
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint8)


def _likely(percent: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                a, b = _rows(batch["marks_u"]), _rows(batch["marks_v"])
                keep = plausible(a, b, batch["n_u"].to_numpy(), batch["n_v"].to_numpy(), percent)
                yield batch.select(["u", "v"]).filter(pa.array(keep))
    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["shingles_u"].cast(pa.binary()), batch["shingles_v"].cast(pa.binary())):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _across(percent: int, verified: bool):
    """Within each ``(key, tile)``, whose rows come one after another, compare
    the two halves of the tile (a single half: with itself), members of
    different components only. Without the sets, give the members that have a
    plausible partner; with them, verified links, of which those between
    members that are connected already are left out. A pair is looked at under
    the first band it shares, and under one size class."""
    def pairs_of(rows):
        sid, root, n, side, pos, marks = rows
        band = int(pos[0]) // 2
        bands = np.zeros((len(sid), BANDS, 8), np.uint8)
        bands[:, :, :ROWS] = marks.reshape(len(sid), BANDS, ROWS)
        bands = bands.reshape(len(sid), -1).view("<u8")[:, :band]
        left, both = np.flatnonzero(side == 0), side.any()
        right = np.flatnonzero(side == 1) if both else left
        order = right[np.argsort(n[right], kind="stable")]
        sizes = n[order]
        for i in left:
            low = np.searchsorted(sizes, -(-percent * n[i] // 100))            # the other set is at least so large
            high = np.searchsorted(sizes, 100 * n[i] // percent, side="right")
            them = order[low:high]
            them = them[(root[them] != root[i]) & ((pos[them] % 2 == 0) | (pos[i] % 2 == 0)) & ((sid[them] > sid[i]) | both)]
            them = them[~(bands[them] == bands[i]).any(axis=1)]
            if len(them):
                mine = np.broadcast_to(marks[i], (len(them), marks.shape[1]))
                them = them[plausible(mine, marks[them], np.full(len(them), n[i]), n[them], percent)]
                if len(them):
                    yield i, them

    def flagged(group, rows):
        seen = np.zeros(len(rows[0]), bool)
        for i, them in pairs_of(rows):
            seen[i] = seen[them] = True
        return pa.RecordBatch.from_arrays([group["key"].chunk(0).filter(pa.array(seen)), pa.array(rows[0][seen])], ["key", "sid"])

    def linked(group, rows):
        sid, root = rows[0], rows[1].copy()
        rows = [sid, root, *rows[2:]]                       # root changes as links are found
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"].chunk(0).cast(pa.binary())]
        u, v = [], []
        for i, them in pairs_of(rows):
            others = np.concatenate([sets[j] for j in them])
            at = np.minimum(np.searchsorted(sets[i], others), len(sets[i]) - 1)
            size = np.array([len(sets[j]) for j in them])
            both = np.add.reduceat((sets[i][at] == others).astype(np.int64), np.cumsum(size) - size)
            for j in them[100 * both >= percent * (len(sets[i]) + size - both)]:
                if root[j] != root[i]:
                    u.append(min(sid[i], sid[j]))
                    v.append(max(sid[i], sid[j]))
                    root[root == root[j]] = root[i]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def emit(group):
        group = group.combine_chunks()
        rows = [group[c].to_numpy() for c in ("sid", "root", "n", "side", "pos")] + [_rows(group["marks"].chunk(0))]
        return (linked if verified else flagged)(group, rows)

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if not len(held):
                continue
            key, tile = held["key"].to_numpy(), held["tile"].to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            for a, b in zip(np.concatenate([[0], edges[:-1]]), edges):
                yield emit(held.slice(a, b - a))
            held = held.slice(edges[-1] if len(edges) else 0).combine_chunks()
        if held is not None and len(held):
            yield emit(held)
    return run


# --- the join ---------------------------------------------------------------

def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar enough."""
    def side(table, name, **columns):
        return table.select(F.col("sid").alias(name), *(F.col(c).alias(f"{a}_{name}") for a, c in columns.items()))
    marks = {"n": "n_shingles", "marks": "marks"}
    likely = pairs.join(side(sketches, "u", **marks), "u").join(side(sketches, "v", **marks), "v") \
                  .select("u", "v", "n_u", "n_v", "marks_u", "marks_v").mapInArrow(_likely(percent), "u long, v long")
    return likely.join(side(sets, "u", shingles="shingles"), "u").join(side(sets, "v", shingles="shingles"), "v") \
                 .select("u", "v", "shingles_u", "shingles_v").mapInArrow(_verified(percent), "u long, v long")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """Members ``(key, sid, root, pos, n)`` once per tile of their bucket: a
    tile is two parts of about ``tile`` shingles, or one part by itself."""
    parts = members.groupBy("key").agg(F.ceil(F.sum("n") / tile).alias("parts"))
    return members.join(parts, "key").withColumn("mine", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("parts"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .select("key", "sid", "root", "pos", "n", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("tile"),
                (F.col("mine") > F.col("other")).cast("long").alias("side"))


def links(docs: DataFrame, sketches: DataFrame, width: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Verified links ``(u, v)`` between the staged distinct sets: enough to
    connect every two sets that are similar enough and share a bucket."""
    size = F.floor(F.log("n_shingles") / F.lit(-math.log(percent / 100 - 0.001))).cast("int")
    band = [F.xxhash64(F.lit(i), F.substring("marks", i * ROWS + 1, ROWS), kind) for i in range(BANDS) for kind in (F.col("kind"), F.col("kind") + 1)]
    keyed = sketches.filter(F.octet_length("marks") > 0).withColumn("kind", size) \
                    .select("sid", F.col("n_shingles").alias("n"), F.posexplode(F.array(*band)).alias("pos", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("sid").alias("lead")).filter("members > 1")
    members = stage(keyed.join(shared, "key"), "setsketch-members")
    wanted = members.select("sid").distinct().join(sketches.select("sid", "at"), "sid") \
                    .select("sid", F.col("at.doc_id").alias("lead_id"), F.col("at.text_hash").alias("lead_hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["lead_id"]) & (texts["text_hash"] == wanted["lead_hash"]))
    sets = stage(texts.select("sid", "text").dropDuplicates(["sid"]).mapInArrow(_sets(width), "sid long, shingles binary"), "setsketch-sets")

    first = members.filter("sid <> lead").select(F.col("lead").alias("u"), F.col("sid").alias("v")).distinct()
    led = stage(_confirmed(first, sketches, sets, percent), "setsketch-links")
    root = connected_components(led).withColumnRenamed("node", "sid")
    placed = members.join(root, "sid", "left").select("key", "sid", "pos", "n", F.coalesce("root", "sid").alias("root"))
    unsettled = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    unsettled = stage(placed.join(unsettled, "key"), "setsketch-unsettled")

    def compared(rows, verified, schema, *tables):
        rows = _tiles(rows, tile)
        for table in tables:
            rows = rows.join(table, "sid")
        slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(slots, "key", "tile").sortWithinPartitions("key", "tile", "sid").mapInArrow(_across(percent, verified), schema).distinct()
    marks = sketches.select("sid", "marks")
    partnered = stage(compared(unsettled, False, "key long, sid long", marks), "setsketch-partnered")
    return led.union(stage(compared(unsettled.join(partnered, ["key", "sid"]), True, "u long, v long", marks, sets), "setsketch-links"))


def near_classes(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    smallest = -(-percent // (100 - percent))         # smaller sets are similar enough to equal sets only
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _sketched(width, smallest), "doc_id long, text_hash long, n_shingles long, set_key binary, marks binary"), "setsketch-rows")
    full = rows.filter("n_shingles > 0")
    sketches = stage(full.groupBy("set_key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.min("n_shingles").alias("n_shingles"),
        F.min("marks").alias("marks")).withColumn("sid", F.monotonically_increasing_id()), "setsketch-sets")
    root = connected_components(links(docs, sketches, width, percent, tile)).withColumnRenamed("node", "sid")
    linked = sketches.select("sid", "set_key", "least_id").join(root, "sid")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    moved = linked.join(least, "root").select("sid", "component_id")
    named = sketches.join(moved, "sid", "left").select("set_key", F.coalesce("component_id", "least_id").alias("component_id"))
    named = full.select("doc_id", "n_shingles", "set_key").join(named, "set_key")
    out = named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")) \
               .union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
