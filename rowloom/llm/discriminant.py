"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document.

One pass turns every text into a short vector of integers (statistics in units of 1/1024). Labelled vectors are summed
per class, with their products, exactly and in parallel; the driver gets those sums alone. Each class has a Gaussian
whose covariance is shrunk towards the pooled one and its diagonal; scores come from the difference of log densities,
with the Mahalanobis distances computed through cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut, prepare, words
from rowloom.llm.rules import repeated_words

UNIT = 1024
#: Shares of the pooled covariance, and of its diagonal, in a class covariance; and the least variance of a feature.
POOLED, DIAGONAL, FLOOR = 0.2, 0.1, 0.02
#: Log-density differences are divided by this before the logistic function; the order of scores doesn't depend on it.
TEMPERATURE = 8.0
CUT = 0.3
FEATURES = ("words", "word length", "length spread", "upper", "title", "digits", "exclamations", "symbols", "bars", "stops", "line length", "distinct words", "distinct lines", "repeats", "foreign")

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def features(text: bytes | None) -> list[int]:
    """The transformed statistics of a text, in units of 1/UNIT; those of the empty text are defined too."""
    text = text or b""
    found = words(text)
    n, size = len(found), max(1, len(text))
    lengths = np.fromiter(map(len, found), np.float64, n) if n else np.zeros(1)
    share = lambda k, of: np.log(k / max(1, of) + 0.004)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = without(UPPER), without(LOWER)
    values = (
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        share(upper, upper + lower),
        share(sum(65 <= w[0] <= 90 for w in found), n),
        share(without(b"0123456789"), size),
        share(without(b"!?"), n),
        share(without(b"#*$%&<>"), n),
        share(without(b"|"), n),
        share(without(b".,;:"), n),
        np.log1p(n / max(1, len(lines))),
        np.log1p(len(set(found)) / max(1, n)) * 4,
        np.log1p(len(set(lines)) / max(1, len(lines))) * 4,
        share(repeated_words(found), n),
        np.sqrt(len(text) - len(text.translate(None, bytes(range(128, 256))))) / np.sqrt(size) * 2,
    )
    return [round(float(v) * UNIT) for v in values]


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log densities' constants of classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) of vectors, tempered."""
        density = [c - 0.5 * ((x - m) @ f.T).__pow__(2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -700, 700)))


def fit(vectors: DataFrame) -> Discriminant | None:
    """From (label, x: array<int>); None unless both classes have rows."""
    size = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + size, 1 + size), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, size).astype(np.int64)
            x = np.concatenate((np.ones((len(x), 1), np.int64), x), axis=1)
            for k in (0, 1):
                sums[k] += x[label == k].T @ x[label == k]
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], ["at", "part"])

    rows = vectors.mapInArrow(run, "at long, part long").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.zeros(2 * (1 + size) ** 2)
    for r in rows:
        sums[r["at"]] = float(r["total"])
    sums = sums.reshape(2, 1 + size, 1 + size)
    n = sums[:, 0, 0]
    if not n.all():
        return None
    means = sums[:, 0, 1:] / n[:, None]
    spread = [s[1:, 1:] - k * np.outer(m, m) for s, m, k in zip(sums, means, n)]
    pooled = sum(spread) / n.sum() / UNIT**2
    factors, constants = [], []
    for s, k in zip(spread, n):
        own = (1 - POOLED - DIAGONAL) * s / k / UNIT**2 + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(size)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(k / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means / UNIT, np.array(factors), np.array(constants))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    held_out: crc32 of the id as text is divisible by 5; labels of such rows are never used. Null labels, and labels
    other than 0 and 1, are left out; a labelled id that several rows have counts once a row. Without labels of both
    classes every score is 0.5. A null or empty text is scored like any other; a null id is not held out and has no
    label. An empty table gives no rows. Other columns of ``docs``, whatever their names, are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "x"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    vectors = cut(chosen.mapInArrow(run, f"doc_id {id_type}, x array<int>"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    used = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    model = fit(vectors.where(~held).join(used, F.col("doc_id") == F.col("l_id")).select("label", "x"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)) / UNIT
            found = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return vectors.select("doc_id", held.alias("held_out"), "x").mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double, predicted int")
