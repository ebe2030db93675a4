"""Substring dedup over the de Bruijn graph of token k-mers.

The k-mers (windows of k words) are the edges of the graph. Neither the edges nor their counts are shuffled one by one:
as in minimiser-based compaction, every window belongs to the anchor (m-mer of least hash, leftmost) inside it, and the
consecutive windows of a document with one anchor form a path of up to k - m + 1 edges, which travels as one row of
hashes with its source coordinates. The joins then compact the repeated paths:

1. An anchor that occurs once has no repeated edge; all its paths go at once.
2. An anchor whose occurrences all carry the same path doesn't branch: the path is repeated as a whole.
3. At an anchor that branches, equal paths collapse into one; if there were several they are repeated as a whole. One
   representative of each distinct path is expanded, at its source coordinates, into its edges, which are matched.

Repeated edges come back as (document, first window, windows); the spans of a document are their union. A common passage is
one aggregate row a task, and Spark can split the joins that bring its occurrences back.

Hashes only propose. When the spans are cut out, the words are read again at the source coordinates, and every occurrence of
a repeated path or edge must have the same BLAKE2 digest of its words. Where a group has two digests, hashes have collided:
all windows of its anchor are then compared by longer digests, and only those stay that two places have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowloom.llm.common import cut, packed, prepare, unpacked, words

WINDOW = 35
ANCHOR = 8
KEPT = 500_000
_BASE = 0x9E3779B97F4A7C15
#: A place is start << 33 | windows << 27 | the text's tag, which with the row's 64-bit key tells apart rows with one id.
TAG_BITS, COUNT_BITS = 27, 6
OUTPUTS = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 15)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                grown = np.full(size, base, np.uint64)
                grown[0] = 1
                setattr(self, name, np.cumprod(grown, dtype=np.uint64))
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequence:
    """Hashes of all word ranges of a document in constant time each; ``bits`` below 64 are for tests of collisions."""

    def __init__(self, hashes: np.ndarray, powers: Powers, bits: int = 64):
        self.up, down = powers.to(len(hashes))
        self.mask = np.uint64((1 << bits) - 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[: len(hashes)], dtype=np.uint64)))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64) * np.uint64(_BASE)) & self.mask


def paths(seq: Sequence, n: int, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, path hash, first window and number of windows of the paths of a document with n >= k words."""
    at = np.arange(n - m + 1)
    hashes = seq.span(at, at + m)
    least, where, size = hashes, at, 1
    while size < k - m + 1:
        step = min(size, k - m + 1 - size)
        later = least[step:] < least[:-step]
        least, where = np.where(later, least[step:], least[:-step]), np.where(later, where[step:], where[:-step])
        size += step
    first = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1))
    count = np.diff(np.append(first, len(where)))
    return hashes[where[first]], seq.span(first, first + count - 1 + k), first, count


def _tag(text: Column) -> Column:
    return F.coalesce(F.hash(text), F.lit(0)).bitwiseAND(F.lit((1 << TAG_BITS) - 1)).cast("long")


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """The texts with a key of 64 bits, of id and text, and a tag by another hash: 91 bits tell rows apart."""
    body = F.col(text).cast("binary")
    key = F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), body)
    return docs.select(*more, key.alias("__doc"), _tag(body).alias("__tag"), body.alias("__text"))


def _paths_of(keyed: DataFrame, k: int, m: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = WordHashes(), Powers()
        for batch in batches:
            parts = []
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = words(text.as_py())
                if len(found) >= k:
                    anchor, path, first, count = paths(Sequence(table.of(found), powers, bits), len(found), k, m)
                    parts.append((anchor.view(np.int64), path.view(np.int64), np.full(len(first), doc), first << (TAG_BITS + COUNT_BITS) | count << TAG_BITS | tag))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["anchor", "path", "doc", "place"])

    return keyed.select("__doc", "__tag", "__text").mapInArrow(run, "anchor long, path long, doc long, place long")


def _edges_of(keyed: DataFrame, chosen: DataFrame, k: int, m: int, bits: int) -> DataFrame:
    """The edges (anchor, edge, doc, place) of chosen paths (doc, place, single); single tells that it occurs once."""
    listed = chosen.groupBy(F.col("doc").alias("c_doc"), F.col("place").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("c_tag")).agg(
        F.collect_set(F.shiftright("place", TAG_BITS) * 2 + F.col("single").cast("long")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = WordHashes(), Powers()
        for batch in batches:
            parts = []
            for doc, tag, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), batch.column(3)):
                found = words(text)
                seq = Sequence(table.of(found), powers, bits)
                places = places.values.to_numpy()
                first, count, single = places >> (COUNT_BITS + 1), places >> 1 & ((1 << COUNT_BITS) - 1), places & 1
                rows = np.repeat(np.arange(len(places)), count)
                window = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                grams = first[:, None] + np.arange(k - m + 1)
                anchor = seq.span(grams, grams + m).min(axis=1)[rows]
                parts.append((anchor.view(np.int64), seq.span(window, window + k).view(np.int64), np.full(len(rows), doc), window << (TAG_BITS + COUNT_BITS) | 1 << TAG_BITS | tag, single[rows] > 0))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["anchor", "edge", "doc", "place", "single"])

    joined = packed(keyed).join(listed, (F.col("__doc") == F.col("c_doc")) & (F.col("__tag") == F.col("c_tag")))
    return joined.select("__doc", "__tag", "__text", "places").mapInArrow(run, "anchor long, edge long, doc long, place long, single boolean")


def repeated(keyed: DataFrame, k: int, m: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc, place, anchor, code, own) of runs of windows whose hashes repeat, in groups by anchor and code, and all paths
    (doc, place, anchor) whose anchor repeats. Rows that aren't ``own`` only stand for their group."""
    found = cut(_paths_of(keyed, k, m, bits))
    counted = (F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))
    anchors = cut(found.groupBy("anchor").agg(*counted).where("n > 1").select(F.col("anchor").alias("a_anchor"), (F.col("low") != F.col("high")).alias("branches")))
    known = cut(found.join(anchors, F.col("anchor") == F.col("a_anchor")).drop("a_anchor"))
    del found, anchors
    branching = known.where("branches").select("anchor", "path", "doc", "place")
    distinct = cut(branching.groupBy("anchor", "path").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("one")))
    several = distinct.where("n > 1").select(F.col("anchor").alias("s_anchor"), F.col("path").alias("s_path"))
    whole = branching.join(several, (F.col("anchor") == F.col("s_anchor")) & (F.col("path") == F.col("s_path")))
    del several
    chosen = distinct.select("one.doc", "one.place", (F.col("n") == 1).alias("single"))
    edges = cut(_edges_of(keyed, chosen, k, m, bits))
    del chosen, distinct
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("doc", "place") for f in (F.min, F.max)]
    different = "min_doc != max_doc OR min_place != max_place"
    shared = cut(edges.groupBy("anchor", "edge").agg(*ends).where(different).select(F.col("anchor").alias("e_anchor"), F.col("edge").alias("e_edge")))
    matched = edges.join(shared, (F.col("anchor") == F.col("e_anchor")) & (F.col("edge") == F.col("e_edge")))
    runs = [df.select("doc", "place", "anchor", F.col("path").alias("code"), F.lit(True).alias("own")) for df in (known.where("NOT branches"), whole)]
    return runs[0].unionByName(runs[1]).unionByName(matched.select("doc", "place", "anchor", F.col("edge").alias("code"), F.col("single").alias("own"))), known.select("doc", "place", "anchor")


def _windows(joined: DataFrame, k: int) -> DataFrame:
    """(anchor, doc, place, high, low): every window of the listed runs with the 128-bit digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, tag, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), batch.column(3).to_pylist()):
                found = words(text)
                for p in listed:
                    first = p["place"] >> (COUNT_BITS + 1)
                    for start in range(first, min(first + (p["place"] >> 1 & ((1 << COUNT_BITS) - 1)), len(found) - k + 1)):
                        digest = hashlib.blake2b(b" ".join(found[start : start + k]), digest_size=16).digest()
                        rows.append((p["set"], doc, start << (TAG_BITS + COUNT_BITS) | 1 << TAG_BITS | tag, *(int.from_bytes(d, "big", signed=True) for d in (digest[:8], digest[8:]))))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "doc", "place", "high", "low"])

    return joined.select("__doc", "__tag", "__text", "__places").mapInArrow(run, "anchor long, doc long, place long, high long, low long")


def _joined(keyed: DataFrame, places: DataFrame, group: Column, how: str) -> DataFrame:
    """The texts, compressed, with their places: start << 7 | windows << 1 | own, and the group of each."""
    one = F.struct((F.shiftright("place", TAG_BITS) * 2 + F.col("own").cast("long")).alias("place"), group.alias("set"))
    listed = places.groupBy(F.col("doc").alias("p_doc"), F.col("place").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("p_tag")).agg(F.collect_set(one).alias("__places"))
    return packed(keyed).join(listed, (F.col("__doc") == F.col("p_doc")) & (F.col("__tag") == F.col("p_tag")), how).drop("p_doc", "p_tag")


def _seen(found: list[bytes], places: np.ndarray, k: int) -> list[int]:
    """A digest of the words of each run (start << 7 | windows << 1 | own)."""
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    first, count = places >> (COUNT_BITS + 1), places >> 1 & ((1 << COUNT_BITS) - 1)
    last = np.minimum(first + count - 1 + k, len(found)) - 1
    start, end = np.where(first > 0, ends[first - 1], 0), ends[last] - 1
    return [int.from_bytes(hashlib.blake2b(joined[a:b], digest_size=8).digest(), "big", signed=True) for a, b in zip(start.tolist(), end.tolist())]


def removed_words(n: int, places: np.ndarray | None, k: int) -> np.ndarray:
    """Which of n words lie in the windows of places (start << COUNT_BITS | windows)."""
    step = np.zeros(n + 1, np.int64)
    if places is not None and len(places):
        first, count = places >> COUNT_BITS, places & ((1 << COUNT_BITS) - 1)
        inside = first + count - 1 + k <= n
        first, count = first[inside], count[inside]
        np.add.at(step, first, 1)
        np.add.at(step, first + count - 1 + k, -1)
    return np.cumsum(step[:n]) > 0


def cut_words(text: bytes, found: list[bytes], removed: np.ndarray) -> bytes:
    """The text without the removed words and the white space behind each; all else stays as it is."""
    if not removed.any():
        return text
    out, at = [], 0
    for word, gone in zip(found, removed.tolist()):
        start = text.index(word, at)
        out.append((b"" if out and gone_before else text[at:start]) + (b"" if gone else word))
        at, gone_before = start + len(word), gone
    if not gone_before:
        out.append(text[at:])
    return b"".join(out)


def _cut_out(docs: DataFrame, doc_id: str, text: str, window: int, anchor: int, keep: list[str], make: Callable[[bytes | None, list[bytes], np.ndarray], tuple], made: T.StructType, bits: int = 64) -> DataFrame:
    """The columns ``keep`` of every document with what ``make`` gives for its text, its words and which of them go."""
    if not 1 <= anchor <= window or window - anchor + 1 >= 1 << COUNT_BITS:
        raise ValueError("the anchor must be shorter than the window, by less than 63 words")
    keyed, bare = _keyed(docs, doc_id, text, *keep), _keyed(docs, doc_id, text)
    kinds = [to_arrow_type(f.dataType) for f in made]
    sets, names = pa.list_(pa.field("element", pa.int64())), [*keep, *made.names, "__sets", "__digests"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *made, *(T.StructField(c, T.ArrayType(T.LongType())) for c in names[-2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, listed in zip(unpacked(batch.column(len(keep))), batch.column(len(keep) + 1)):
                found, own, groups, digests = words(body), None, [], []
                if listed.is_valid:
                    places, groups = listed.values.field("place").to_numpy(), listed.values.field("set").to_pylist()
                    own, digests = places[places & 1 > 0] >> 1, _seen(found, places, window)
                rows.append((*make(body, found, removed_words(len(found), own, window)), groups, digests))
            columns = list(zip(*rows)) or [[]] * (len(kinds) + 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, [*kinds, sets, sets]))], names)

    def cut_out(places: DataFrame) -> DataFrame:
        joined = _joined(keyed, places, F.xxhash64("anchor", "code"), "left")
        return cut(joined.select(*keep, "__text", "__places").mapInArrow(run, schema))

    places, known = repeated(bare, window, anchor, bits)
    done = cut_out(places)
    seen = done.where(F.size("__sets") > 0).select(F.explode(F.arrays_zip("__sets", "__digests")).alias("x"))
    ends = seen.groupBy(F.col("x.__sets").alias("w_set")).agg(F.min("x.__digests").alias("low"), F.max("x.__digests").alias("high"))
    wrong = cut(ends.where("low != high").select("w_set"))
    if not wrong.isEmpty():
        anchors = cut(places.join(wrong, F.xxhash64("anchor", "code") == F.col("w_set"), "left_semi").select(F.col("anchor").alias("w_anchor")).distinct())
        on = F.col("anchor") == F.col("w_anchor")
        doubtful = known.join(anchors, on, "left_semi").withColumn("own", F.lit(True))
        windows = cut(_windows(_joined(bare, doubtful, F.col("anchor"), "inner"), window))
        same = windows.groupBy(*(F.col(c).alias(f"s_{c}") for c in ("anchor", "high", "low"))).count().where("count > 1").drop("count")
        true = windows.join(same, (F.col("anchor") == F.col("s_anchor")) & (F.col("high") == F.col("s_high")) & (F.col("low") == F.col("s_low")))
        true = true.select("doc", "place", "anchor", F.lit(0).cast("long").alias("code"), F.lit(True).alias("own"))
        done = cut_out(places.join(anchors, on, "left_anti").unionByName(true))
    return done.drop("__sets", "__digests")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, spans: bool = False, hash_bits: int = 64) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), and with
    ``spans`` the removed spans as an array of (start, end) word positions.

    A word goes if it lies in a window of ``window`` words whose sequence also starts anywhere else, in this document or
    another. Windows are judged on the input. A null or empty text has no words; a text shorter than a window loses
    none. Rows that repeat an id, or an id and a text, are documents of their own (equal rows repeat each other). A null
    id gives a null id; ids may be of any type that can be hashed. An empty table gives no rows. Other columns of
    ``docs``, whatever their names, are not read. ``hash_bits`` below 64 are for tests of collisions.
    """
    prepare(docs.sparkSession)
    made = T.StructType([T.StructField(c, T.LongType() if t == "long" else T.StringType()) for c, t in OUTPUTS.items()])
    if spans:
        made.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))

    def make(body: bytes | None, found: list[bytes], gone: np.ndarray) -> tuple:
        row = (len(found), int(gone.sum()), hashlib.sha256(b" ".join(compress(found, ~gone))).hexdigest())
        if not spans:
            return row
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        return (*row, [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _cut_out(named, "doc_id", "text", window, anchor, ["doc_id"], make, made, hash_bits)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with the removed words cut out of ``text``; the rest of a text keeps its white space.

    All columns stay; ``n_chars``, if there is such a column, is the length of the new text. Every row stays, even one
    that loses all its words; a null text stays null. Ids may be null, repeated and of any type that can be hashed.
    """
    prepare(docs.sparkSession)
    names = docs.columns

    def make(body: bytes | None, found: list[bytes], gone: np.ndarray) -> tuple:
        return (None if body is None else zstandard.ZstdCompressor(level=3).compress(cut_words(body, found, gone)),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            texts = [None if t is None else t.decode("utf-8", "replace") for t in unpacked(batch.column(len(names)))]
            columns[text] = pa.array(texts, pa.string())
            if n_chars in columns:
                columns[n_chars] = pa.array([None if t is None else len(t) for t in texts], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    kept = [c for c in names if c != text]
    done = _cut_out(docs, doc_id, text, window, anchor, kept, make, T.StructType([T.StructField("__packed", T.BinaryType())]))
    filled = done.withColumn(text, F.lit(None).cast("string")).select(*names, "__packed")
    return filled.mapInArrow(run, docs.schema)
