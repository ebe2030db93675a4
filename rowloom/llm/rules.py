"""Quality rules: base counts of a text, and the log-likelihood ratio of its hashed n-grams.

Byte n-grams are hashed into 2**16 buckets and counted in all documents (the raw corpus) and in all trusted ones. The two
multinomials, smoothed alike at the size of the trusted texts, give a log ratio a bucket; a document's score is the mean of
the ratios of its n-grams, and it is kept if the score reaches a threshold. The tables have a fixed size whatever the corpus.
The trusted ids may be any number: they are never broadcast, but meet the texts, compressed, in a join; texts are read
three times and shuffled once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import packed, prepare, unpacked, words

#: Lengths of the hashed n-grams, in bytes.
ORDERS = (2, 3)
BUCKETS = 1 << 16
PARTS = 64
#: Added to each bucket's count in the trusted texts, and to the count that the raw corpus would have at their size.
SMOOTHING = 0.5
#: Clean texts score about 0 however much of the corpus is clean; it takes a share of n-grams foreign to the trusted texts to get here.
THRESHOLD = -0.2
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
STEP = 1 << 20
STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "llr": "double", "kept": "boolean"}


def repeated_words(found: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that the text has twice or more, the first one included."""
    n = len(found) - size + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = defaultdict(count().__next__)
    code = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
    key = code[:n]
    for k in range(1, size):
        if key.max() * len(codes) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(codes) + code[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    covered = np.zeros(len(found), bool)
    for k in range(size):
        covered[at + k] = True
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    found = words(text)
    joined = np.frombuffer(b"".join(found), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(found), int(np.count_nonzero(joined & 0xC0 != 0x80)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(found)


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in blocks."""
    whole = np.frombuffer(text, np.uint8)
    for i in range(0, len(whole), STEP):
        part = whole[i : i + STEP + max(ORDERS) - 1].astype(np.uint32)
        key = part
        for n in range(2, max(ORDERS) + 1):
            key = key[:-1] << np.uint32(8) | part[n - 1 :]
            if n in ORDERS and len(key):
                yield (((key[: STEP]) ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _text(value: pa.Scalar) -> bytes:
    return value.as_py() or b""


def _counted(texts: DataFrame, read: Callable[[pa.Array], Iterable[bytes | None]]) -> np.ndarray:
    """How often each bucket occurs in the texts, the only column. Every task sends its counts in PARTS dense rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(BUCKETS, np.int64), [np.zeros(0, np.uint32)], 0
        for batch in batches:
            for body in read(batch.column(0)):
                for bucket in grams(body or b""):
                    waiting.append(bucket)
                    size += len(bucket)
                    if size >= STEP:
                        counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                        waiting, size = waiting[:1], 0
        counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        if counts.any():
            yield rows(enumerate(counts.reshape(PARTS, -1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + counts.values.to_numpy()
        if sums:
            yield rows(sums.items())

    def rows(found: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        parts, counts = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(counts, pa.list_(pa.field("element", pa.int64())))], ["part", "counts"])

    schema, table = "part int, counts array<long>", np.zeros((PARTS, BUCKETS // PARTS))
    for part, counts in texts.mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect():
        table[part] += counts
    return table.ravel()


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratios of the buckets: of all trusted documents (column doc_id) to all documents."""
    prepare(docs.sparkSession)
    bodies = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text"))
    listed = trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted IS NOT NULL").distinct()
    chosen = packed(bodies.where("__id IS NOT NULL")).join(listed.hint("merge"), F.col("__id") == F.col("__trusted"), "left_semi")
    raw = _counted(bodies.select("__text"), lambda column: map(_text, column))
    good = _counted(chosen.select("__text"), unpacked)
    if not good.any():
        return np.zeros(BUCKETS)
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + SMOOTHING) / (expected + SMOOTHING))


def judge(docs: DataFrame, ratios: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, only_kept: bool = False) -> DataFrame:
    """The columns ``keep`` of every document and STATS, or with ``only_kept`` the columns of the kept documents alone."""
    prepare(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(np.asarray(ratios))
    kept = [c for c in keep if only_kept or c not in STATS]
    outputs = {} if only_kept else STATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            rows = []
            for value in batch.column(len(kept)):
                body = _text(value)
                counts = base_counts(body)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
                total, n = 0.0, 0
                if not (failed and only_kept):
                    for bucket in grams(body):
                        total, n = total + float(ratio[bucket].sum()), n + len(bucket)
                score = total / n if n else 0.0
                rows.append((*counts, failed, score, not failed and score >= threshold))
            columns = list(zip(*rows)) or [[] for _ in STATS]
            if only_kept:
                chosen = pa.array(columns[-1], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(chosen) for k in range(len(kept))], kept)
            else:
                kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *(pa.array(c, kinds[t]) for c, t in zip(columns, STATS.values()))], [*kept, *outputs])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {t}" for c, t in outputs.items()])
    return docs.select(*kept, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and STATS for every document.

    A null or empty text has no words and fails the base rules. Without trusted documents all scores are 0. Rows that
    repeat an id are judged each by its own text and count as trusted if the id is; a null id never does. An empty table
    gives no rows. Other columns of ``docs``, whatever their names, are not read.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return judge(named, fit(named, trusted), threshold=threshold)
