"""The quadratic discriminant against a plain one: covariances row by row, explicit inverses and determinants."""

from __future__ import annotations

import random
import zlib

import numpy as np

from rowloom.llm import discriminant
from tests.llm.conftest import SCHEMA, prose


def plain_scores(rows, labels):
    """Scores of all rows from the labelled ones whose crc32 isn't divisible by five."""
    x = [np.array(discriminant.features((t or "").encode())) / discriminant.UNIT for _, t in rows]
    by_id: dict = {}
    for (i, _), v in zip(rows, x):
        if i is not None and zlib.crc32(str(i).encode()) % 5:
            by_id.setdefault(i, []).append(v)
    groups = [[v for i, q in sorted(set(labels)) if q == k for v in by_id.get(i, [])] for k in (0, 1)]
    means = [sum(g) / len(g) for g in groups]
    scatter = [sum(np.outer(v - m, v - m) for v in g) for g, m in zip(groups, means)]
    n = [len(g) for g in groups]
    pooled = sum(scatter) / sum(n)
    a, b, c = discriminant.POOLED, discriminant.DIAGONAL, discriminant.FLOOR
    density = []
    for k in (0, 1):
        own = (1 - a - b) * scatter[k] / n[k] + a * pooled + b * np.diag(np.diag(pooled)) + c * np.eye(len(pooled))
        inverse, logdet = np.linalg.inv(own), np.linalg.slogdet(own)[1]
        density.append([np.log(n[k] / sum(n)) - 0.5 * logdet - 0.5 * (v - means[k]) @ inverse @ (v - means[k]) for v in x])
    return [1 / (1 + np.exp(-(p - q) / discriminant.TEMPERATURE)) for q, p in zip(*density)]


def test_scores_against_a_plain_discriminant(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 200)) if i % 2 else " ".join(rng.choice(["BUY", "!!!", "$$$", "x1", "|"]) for _ in range(rng.randrange(1, 90))) for i in range(120)]
    texts[7], texts[8], texts[9] = None, "", "w " * 30_000
    rows = list(enumerate(texts)) + [(11, texts[30]), (None, texts[31]), (12, texts[12])]
    labels = [(i, i % 2) for i in range(0, 100)] + [(3, 1), (500, 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    table = spark.createDataFrame([(i, q, 0) for i, q in [*labels, (None, 1), (13, None), (15, 7)]], "doc_id long, quality int, toxic int")
    got = discriminant.classify(docs, table).collect()
    want = plain_scores(rows, labels)
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 6))
    pairs = zip(sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(((i, s) for (i, _), s in zip(rows, want)), key=key))
    assert len(got) == len(rows) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in pairs)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if r["held_out"] and 10 < r["doc_id"] < 100]) >= 0.9
