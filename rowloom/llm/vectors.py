"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class. A rotation, learnt on a bounded sample, turns a vector into balanced bits; the code is cut
into substrings, each the key of a table. Only ids and codes go to the tables: a first pass compares the codes that share a
key by Hamming distance and tells which vectors have a candidate in which bucket. A second pass brings the original vectors
to those buckets alone and reranks by cosine, in double precision. A pair counts in the first table that it shares, so no
pair counts twice and none is sent anywhere: a task adds up links and returns, besides, a spanning forest of them. Buckets
with very many vectors are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut, prepare
from rowloom.llm.components import Forest, components
from rowloom.llm.runs import whole_groups

THRESHOLD = 0.9
#: Distinct vectors that the rotations are learnt on, at most: those of least hash.
MAX_SAMPLE = 10_000
ROUNDS = 30
#: The share of links at the very threshold that the tables should find if bits were independent.
RECALL = 0.98
#: The share of the sample's links near the threshold that the tables must find.
FOUND = 0.95
#: Vectors are coded without centring where it would take more tables than this.
MAX_TABLES = 128
#: Links of the sample that the tables are tried on.
TRIED = 10_000
BITS = 64
#: Vectors of a bucket's block.
BLOCK = 4096
TILE = 1024


@dataclass(frozen=True)
class Index:
    """Projections (d x bits) of the rotations, their offsets, the width of a table's key, and the most bits in which
    candidates differ: in one rotation, and in all together."""

    dimension: int
    mean: np.ndarray
    projections: list[np.ndarray]
    width: int
    radius: int
    reach: int

    @property
    def tables(self) -> int:
        return self.projections[0].shape[1] // self.width

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors to codes, one column a rotation."""
        bits = [((x - self.mean) @ p > 0) for p in self.projections]
        padded = [np.pad(b, ((0, 0), (0, 64 - b.shape[1]))) for b in bits]
        return np.stack([np.packbits(b, axis=1, bitorder="little").view(np.uint64)[:, 0] for b in padded], axis=1)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The key of every table of every rotation."""
        shifts = (np.arange(self.tables) * self.width).astype(np.uint64)
        parts = (codes[:, :, None] >> shifts) & np.uint64((1 << self.width) - 1)
        return parts.reshape(len(codes), codes.shape[1] * self.tables).astype(np.int64)


def _near_pairs(sample: np.ndarray, threshold: float, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with a cosine from the threshold to ``above``."""
    found, count = [], 0
    for i in range(0, len(sample), TILE):
        cosine = sample[i : i + TILE] @ sample[i:].T
        p, q = np.nonzero((cosine >= threshold) & (cosine <= above))
        found.append(np.stack((p + i, q + i))[:, p < q])
        count += found[-1].shape[1]
        if count > TRIED:
            break
    p, q = np.concatenate(found, axis=1)[:, :TRIED] if found else np.zeros((2, 0), np.int64)
    return p, q


def _tables(angle: float, width: int) -> float:
    """Tables that find RECALL of the pairs at an angle (1: opposite)."""
    same = (1 - angle) ** width
    return 1 if same >= RECALL else ceil(log(1 - RECALL) / log(1 - same)) if same > 1e-9 else float("inf")


def learn(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, seed: int = 7, width: int | None = None) -> Index:
    """Rotations by iterative quantisation: alternate codes and the orthogonal map that fits them best.

    A pair at the threshold has a wider angle once the vectors' common part is taken away: the number of tables follows
    from that angle, and grows, to 2 * MAX_TABLES at most, until they find both the links near the threshold of the sample
    and its links of any cosine. A wider key keeps buckets small where there are more rows.
    """
    d = sample.shape[1]
    bits = min(BITS, d)
    width = min(bits, width or (8 if rows <= 1 << 20 else 12 if rows <= 1 << 26 else 16))
    bits -= bits % width
    tables = bits // width
    mean = sample.mean(axis=0)
    common = min(float(mean @ mean), 1 - 1e-9)
    angle = acos(max(-1.0, (threshold - common) / (1 - common))) / pi
    if _tables(angle, width) > MAX_TABLES:
        mean, angle = np.zeros(d), acos(threshold) / pi
    wanted = _tables(angle, width)
    centred = sample - mean
    basis = np.linalg.svd(centred.T @ centred / (len(sample) - 1) if len(sample) > 1 else np.eye(d))[0][:, :bits]
    reduced = centred @ basis
    generator = np.random.default_rng(seed)
    projections: list[np.ndarray] = []
    expected = angle * bits
    radius = min(bits, ceil(expected + 6 * sqrt(expected * (1 - angle)) + 1))
    tried = [_near_pairs(sample, threshold, threshold + 0.2 * (1 - threshold)), _near_pairs(sample, threshold, 2.0)]
    missed = [np.ones(len(p), bool) for p, _ in tried]
    differ = [np.zeros(len(p), np.int64) for p, _ in tried]
    while len(projections) < ceil(wanted / tables) or any(len(m) and m.mean() > 1 - FOUND for m in missed) and len(projections) * tables < 2 * MAX_TABLES:
        rotation = np.linalg.qr(generator.standard_normal((bits, bits)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(reduced @ rotation > 0, 1.0, -1.0).T @ reduced)
            rotation = (left @ right).T
        projections.append(basis @ rotation)
        one = Index(d, mean, projections[-1:], width, radius, radius)
        for k, (p, q) in enumerate(tried):
            a, b = one.codes(sample[p]), one.codes(sample[q])
            apart = np.bitwise_count(a ^ b)[:, 0]
            missed[k] &= ~((one.keys(a) == one.keys(b)).any(axis=1) & (apart <= radius))
            differ[k] += apart
    expected *= len(projections)
    reach = max([ceil(expected + 4.5 * sqrt(expected * (1 - angle)) + 1), *(int(x.max()) + 1 for x in differ if len(x))])
    return Index(d, mean, projections, width, radius, min(reach, bits * len(projections)))


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(classes: DataFrame, index: Index) -> DataFrame:
    """(slot, key, id, codes) of every class in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TILE):
                batch = whole.slice(i, TILE)
                codes = index.codes(_unit(batch.column(1), index.dimension))
                keys = index.keys(codes)
                at = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                listed = pa.FixedSizeListArray.from_arrays(pa.array(codes.view(np.int64).ravel()), codes.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))), pa.array(keys.ravel().astype(np.int32)), batch.column(0).take(at), listed.take(at)], ["slot", "key", "id", "codes"])

    return classes.select("id", "vector").mapInArrow(run, "slot int, key int, id long, codes array<long>")


def _pairs(index: Index, slot: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks (codes, keys) whose first shared table is ``slot`` and whose codes are near."""
    (codes1, keys1), (codes2, keys2) = left, right
    turn = slot // index.tables
    for i in range(0, len(codes1), TILE):
        for j in range(i if same else 0, len(codes2), TILE):
            near = np.bitwise_count(codes1[i : i + TILE, turn, None] ^ codes2[None, j : j + TILE, turn]) <= index.radius
            if same and i == j:
                near &= np.triu(np.ones(near.shape, bool), 1)
            p, q = np.nonzero(near)
            p, q = p + i, q + j
            if codes1.shape[1] > 1:
                apart = np.zeros(len(p), np.int64)
                for r in range(codes1.shape[1]):
                    apart += np.bitwise_count(codes1[p, r] ^ codes2[q, r])
                p, q = p[apart <= index.reach], q[apart <= index.reach]
            for earlier in range(slot):
                if not len(p):
                    break
                new = keys1[p, earlier] != keys2[q, earlier]
                p, q = p[new], q[new]
            if len(p):
                yield p, q


def _reaching(x1: np.ndarray, x2: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs whose cosine reaches the threshold; each is summed by itself, so that it decides alike anywhere."""
    hit = np.concatenate([np.einsum("ij,ij->i", x1[p[i : i + TILE]], x2[q[i : i + TILE]]) >= threshold for i in range(0, len(p), TILE)])
    return p[hit], q[hit]


KEYS = ["slot", "key", "low", "high"]


def _candidates(coded: DataFrame, index: Index) -> DataFrame:
    """(slot, key, low, high, own, id): the vectors that have a candidate in a bucket, or in its pair of blocks."""
    sizes = coded.groupBy("slot", "key").count().where("count > 1")
    sizes = sizes.select(F.col("slot").alias("s_slot"), F.col("key").alias("s_key"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = coded.join(sizes, (F.col("slot") == F.col("s_slot")) & (F.col("key") == F.col("s_key")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("slot", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "codes")
    ordered = dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, KEYS, 4 * BLOCK):
            slots, low, high, own = (table.column(c).to_numpy() for c in ("slot", "low", "high", "own"))
            codes = table.column("codes").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            prints = index.keys(codes)
            some = np.zeros(len(codes), bool)
            for s, m, e in _sides(at, low, high, own):
                same = m == e
                two = (codes[s:e], prints[s:e]) if same else (codes[m:e], prints[m:e])
                for p, q in _pairs(index, int(slots[s]), (codes[s:m], prints[s:m]), two, same):
                    some[p + s] = some[q + (s if same else m)] = True
            yield from table.select([*KEYS, "own", "id"]).take(pa.array(np.flatnonzero(some))).combine_chunks().to_batches()

    return ordered.mapInArrow(run, "slot int, key int, low int, high int, own int, id long")


def _sides(at: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, middle, end) of each group: its two blocks, or one block (middle = end) to be compared with itself."""
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        m = e if low[s] == high[s] else s + int(np.searchsorted(own[s:e], high[s]))
        if s < m and (m < e or low[s] == high[s]):
            yield s, m, e


def _links(chosen: DataFrame, classes: DataFrame, index: Index, threshold: float) -> DataFrame:
    """(a, b, links): links of class a when b is null, else an edge."""
    met = chosen.join(classes.select(F.col("id").alias("c_id"), "copies", "vector"), F.col("id") == F.col("c_id")).drop("c_id")
    ordered = met.repartition(*KEYS).sortWithinPartitions(*KEYS, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, KEYS, 4 * BLOCK):
            ids, copies, own = (table.column(c).to_numpy() for c in ("id", "copies", "own"))
            slots, low, high = (table.column(c).to_numpy() for c in ("slot", "low", "high"))
            x = _unit(table.column("vector").combine_chunks(), index.dimension)
            codes = np.concatenate([index.codes(x[i : i + TILE]) for i in range(0, len(x), TILE)])
            prints = index.keys(codes)
            links, forest = np.zeros(len(x), np.int64), Forest(len(x))
            for s, m, e in _sides(at, low, high, own):
                same = m == e
                two = slice(s, e) if same else slice(m, e)
                for p, q in _pairs(index, int(slots[s]), (codes[s:m], prints[s:m]), (codes[two], prints[two]), same):
                    p, q = _reaching(x[s:m], x[two], p, q, threshold)
                    p, q = p + s, q + two.start
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    forest.link(p, q)
            child = np.flatnonzero(forest.label != np.arange(len(x)))
            some = np.flatnonzero(links)
            a = np.concatenate((ids[child], ids[some]))
            b = pa.array(np.concatenate((ids[forest.label[child]], ids[some])), mask=np.arange(len(a)) >= len(child))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate((np.zeros(len(child), np.int64), links[some])))], ["a", "b", "links"])

    return ordered.mapInArrow(run, "a long, b long, links long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, width: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable, itself included; kept
    tells whether that is its own. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; others link with those of their length. Equal vectors link. Vectors may be of any number type; floats travel
    as floats, others as doubles, and cosines are doubles. Ids may be of any type that has an order; rows that repeat an
    id with other vectors are vectors of their own. A null id is never linked and has a null component. An empty table
    gives no rows. Other columns are not read. ``width`` is that of the tables' keys (None: by the number of rows).
    """
    prepare(rows.sparkSession)
    single = rows.schema[embedding].dataType.simpleString() == "array<float>"
    chosen = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    chosen = chosen.withColumn("sound", sound)
    lengths = [r["d"] for r in chosen.where("sound").groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()]
    told = chosen.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for d in lengths:
        told = _linked(chosen.where(F.col("sound") & (F.size("vector") == d)).select("vec_id", "vector"), d, threshold, width).unionByName(told)
    return told.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(valid: DataFrame, dimension: int, threshold: float, width: int | None) -> DataFrame:
    """vec_id, n_links and component_id of sound vectors of one length."""
    classes = cut(valid.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    sample = classes.orderBy(F.xxhash64("vector"), "first").limit(MAX_SAMPLE).select("vector").toArrow().column(0)
    index = learn(_unit(sample.combine_chunks(), dimension), classes.count(), threshold, width=width)
    near = cut(_candidates(_coded(classes, index), index))
    found = cut(_links(near, classes, index, threshold))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "k_id")
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    told = cut(classes.join(links, F.col("id") == F.col("k_id"), "left").join(parts, F.col("id") == F.col("node"), "left").select("vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    firsts = told.groupBy(F.col("component").alias("f_component")).agg(F.min("first").alias("component_id"))
    told = told.join(firsts, F.col("component") == F.col("f_component")).select(F.col("vector").alias("t_vector"), "n_links", "component_id")
    return valid.join(told, F.col("vector") == F.col("t_vector")).select("vec_id", "n_links", "component_id")
