"""SimHash near-dedup: 64-bit fingerprints, linked by a self-join of binary tries.

Fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit blocks at least (k bits: k + 1 blocks). So each
of the four rotations that put a block on top makes a trie whose node pairs can be pruned at once where their top 16 bits
differ; what is left is one subtrie a block value, joined with itself in one task. The join goes down in node pairs, adds
the bits in which they differ, and drops a pair when its error budget is exceeded. Where a subtrie has very many
fingerprints its lower bits are cut into four blocks again, each of which turns to the top in one of four copies, and so
on: subtries get deeper where there are more fingerprints. A task returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import cut, prepare, words
from rowloom.llm.components import Forest, components
from rowloom.llm.runs import whole_groups

SHINGLE = 3
BITS = 3
#: Bits in which texts differ on average whose sets of five-word shingles have a Jaccard similarity of 0.8.
NEAR_BITS = 7
SEED = 42
#: A subtrie with more fingerprints is split further.
HOT = 20_000
#: Tables of large subtries up to this many rows are broadcast.
FEW = 10_000
#: Node pairs that a task holds at once.
FRONTIER = 1 << 18
CHUNK_ROWS = 100_000


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text over XXH64 of its lower-cased word shingles; 0 if it has no words."""
    found = words(text.encode("utf-8").lower() if isinstance(text, str) else text and text.lower())
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(found) - shingle] + 1)).tolist()
    ends = np.append(gaps[shingle - 1 :], len(joined)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """(doc_id, fp, and the columns ``more``): the fingerprint of every text as a signed long."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), *(c.alias(n) for n, c in more.items()))
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("fp", T.LongType()), *(chosen.schema[n] for n in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], schema.names)

    prepare(docs.sparkSession)
    return chosen.mapInArrow(run, schema)


def join_tries(values: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within ``bits`` differing bits, from node pairs (low1, high1, low2, high2).

    A node is a range of ``values`` (unsigned, sorted inside each root) with equal bits above ``depth``; a pair of a
    node with itself stands for the pairs inside it. Memory is bounded: the frontier is a stack of blocks.
    """
    bit_sums: dict[int, np.ndarray] = {}

    def zeros(d: int) -> np.ndarray:
        if d not in bit_sums:
            bit_sums[d] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1) == 0)))
        return bit_sums[d]

    stack = [(depth, *pairs, np.zeros(len(pairs[0]), np.int8))]
    while stack:
        d, l1, h1, l2, h2, err = stack.pop()
        if len(l1) > FRONTIER:
            stack += [(d, *(x[i : i + FRONTIER] for x in (l1, h1, l2, h2, err))) for i in range(0, len(l1), FRONTIER)]
            continue
        size1, size2 = h1 - l1, h2 - l2
        small = size1 * size2 <= 16
        if small.any():
            a, n1, b, n2 = l1[small], size1[small], l2[small], size2[small]
            at = np.repeat(np.arange(len(a)), n1 * n2)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n1 * n2) - n1 * n2, n1 * n2)
            x, y = a[at] + nth // n2[at], b[at] + nth % n2[at]
            near = (x < y) & (np.bitwise_count(values[x] ^ values[y]) <= bits)
            if near.any():
                yield x[near], y[near]
        if small.all():
            continue
        l1, h1, l2, h2, err = (x[~small] for x in (l1, h1, l2, h2, err))
        if d == 64:
            continue
        z = zeros(d)
        m1, m2 = l1 + z[h1] - z[l1], l2 + z[h2] - z[l2]
        same = l1 == l2
        down = [(l1, m1, l2, m2, err), (m1, h1, m2, h2, err), (l1, m1, m2, h2, err + 1)]
        down.append(tuple(x[~same] for x in (m1, h1, l2, m2, err + 1)))
        children = tuple(np.concatenate(x) for x in zip(*down))
        keep = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= bits)
        stack.append((d + 1, *(x[keep].astype(x.dtype) for x in children)))


def _deeper(rows: DataFrame, depth: int, blocks: int) -> DataFrame:
    """Each row once for each block of the bits below ``depth``, with the bits turned so that the block is next.

    Values that agree above ``depth`` and differ in fewer bits than there are blocks agree in one of the blocks too.
    """
    below, width = 64 - depth, (64 - depth) // blocks
    low = (1 << below) - 1 if below < 64 else -1
    value, kept = F.col("value"), F.col("value").bitwiseAND(F.lit(~low))

    def turned(by: int) -> Column:
        rest = value.bitwiseAND(F.lit(low))
        return kept.bitwiseOR(F.shiftleft(rest, by).bitwiseAND(F.lit(low))).bitwiseOR(F.shiftrightunsigned(rest, below - by)) if by else value

    each = F.explode(F.array(*(F.struct((F.col("trail") * blocks + r).alias("trail"), turned(r * width).alias("value")) for r in range(blocks))))
    found = rows.select("fp", each.alias("t")).select("fp", "t.trail", "t.value")
    return found.withColumn("node", F.shiftrightunsigned("value", below - width))


def near_links(prints: DataFrame, bits: int = BITS, hot: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that are within ``bits`` <= 7 bits.

    The edges of one subtrie are a spanning forest of its links, so they are fewer than its fingerprints. Subtries with
    more than ``hot`` fingerprints are split as long as that makes them smaller by more than it copies them.
    """
    if not 0 <= bits <= 7:
        raise ValueError("tries are joined for up to 7 differing bits")
    hot, blocks = hot or (HOT if bits <= BITS else HOT // 5), bits + 1
    first = depth = 64 // blocks
    rows, cold = _deeper(prints.select("fp", F.lit(1).cast("long").alias("trail"), F.col("fp").alias("value")), 0, blocks), []
    while 1 << (width := (64 - depth) // blocks) > blocks:
        large = rows.groupBy("trail", "node").count().where(F.col("count") > hot).select(F.col("trail").alias("h_trail"), F.col("node").alias("h_node"))
        if not (number := (large := cut(large)).count()):
            break
        marked = rows.join(F.broadcast(large) if number <= FEW else large, (F.col("trail") == F.col("h_trail")) & (F.col("node") == F.col("h_node")), "left")
        cold.append(marked.where("h_node IS NULL").select(rows.columns))
        rows = cut(_deeper(marked.where("h_node IS NOT NULL"), depth, blocks))
        depth += width
    keys = ["trail", "node"]
    unsigned = F.col("value").bitwiseXOR(F.lit(-(1 << 63)))
    ordered = reduce(DataFrame.union, [*cold, rows]).repartition(*keys).sortWithinPartitions(*keys, unsigned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys, CHUNK_ROWS):
            values, fp = table.column("value").to_numpy().view(np.uint64), table.column("fp").to_numpy()
            start, end = at[:-1], at[1:]
            some = end - start > 1
            forest = Forest(len(values))
            for a, b in join_tries(values, (start[some], end[some], start[some], end[some]), first, bits):
                forest.link(a, b)
            child = np.flatnonzero(forest.label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[forest.label[child]])], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _classes(prints: DataFrame, least: Column, bits: int) -> DataFrame:
    """(l_fp, first): every fingerprint with the least value of its class."""
    distinct = cut(prints.groupBy("fp").agg(F.min(least).alias("own")))
    found = components(near_links(distinct.select("fp"), bits))
    labelled = cut(distinct.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("l_fp"), "own", F.coalesce("component", "fp").alias("component")))
    firsts = cut(labelled.groupBy(F.col("component").alias("f_component")).agg(F.min("own").alias("first")))
    return labelled.join(firsts, F.col("component") == F.col("f_component")).select("l_fp", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): documents in classes of fingerprints linked at ``bits`` or fewer differing bits.

    component_id is the smallest doc_id reachable by links, itself included; ids may be of any type that has an order.
    Texts that are null, empty or only white space have fingerprint zero and are linked like any other. Rows that repeat
    an id or a text each give a row; a null id gives a row too and is never a component's id unless all are null. An
    empty table gives no rows. Other columns of ``docs``, whatever their names, are not read. Copies are one
    fingerprint, so a group of copies is one trie leaf.
    """
    prints = cut(fingerprints(docs, doc_id, text))
    classes = _classes(prints, F.col("doc_id"), bits)
    return prints.join(classes, F.col("fp") == F.col("l_fp")).select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = NEAR_BITS) -> DataFrame:
    """One row of each class of near copies, with the columns of ``docs``: that of the smallest id.

    Copies are near if their fingerprints differ in at most ``bits`` bits. By default these are 7 of 64, which is what texts
    of a Jaccard similarity of 0.8 between their sets of five-word shingles differ in on average.

    Rows with a null id come after all others. Of a class's rows that share its smallest id the one whose columns have
    the least 64-bit hash stays (columns that hold maps are left out of it); equal rows are one. So classes never lose
    their last row, however often ids repeat. An empty table gives no rows.
    """
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    prints = cut(fingerprints(docs, doc_id, text, row=whole))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    chosen = cut(_classes(prints, rank, bits).select(F.col("first.id").alias("__kept_id"), F.col("first.row").alias("__kept_row")).distinct())
    on = F.col(f"`{doc_id}`").eqNullSafe(F.col("__kept_id")) & (F.col("__row") == F.col("__kept_row"))
    kept = docs.withColumn("__row", whole).join(chosen, on, "left_semi")
    equal = prints.groupBy("doc_id", "row").count().where("count > 1")
    equal = cut(equal.join(chosen, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("row") == F.col("__kept_row")), "left_semi").select(F.col("doc_id").alias("__kept_id"), F.col("row").alias("__kept_row")))
    if not equal.isEmpty():
        kept = kept.join(equal, on, "left_anti").unionByName(kept.join(equal, on, "left_semi").dropDuplicates([doc_id, "__row"]))
    return kept.select(*(f"`{c}`" for c in docs.columns))
