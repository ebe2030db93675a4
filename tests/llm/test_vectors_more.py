"""Recall of embedding links end to end: common means, clusters with an offset, wide keys; doubles and ids of any type."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from rowloom.llm import vectors


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shifted(rng, mean: float, n: int = 800, d: int = 64) -> np.ndarray:
    """Vectors of a mean cosine, in pairs at cosines around 0.91."""
    offset, u, w = np.eye(d)[0], unit(rng.standard_normal((n, d))), unit(rng.standard_normal((n, d)))
    near = (0.915 - mean) / (1 - mean)
    v = near * u + np.sqrt(1 - near**2) * w
    both = np.sqrt(mean) * offset + np.sqrt(1 - mean) * np.concatenate((u, v))
    return unit(both)


def clusters(rng, n: int = 1200, d: int = 64) -> np.ndarray:
    """Tight clusters about centres that share a strong direction."""
    centres = unit(3 * np.eye(d)[0] + unit(rng.standard_normal((30, d))))
    return unit(centres[rng.integers(0, 30, n)] + 0.04 * rng.standard_normal((n, d)))


def recall(spark, x: np.ndarray, width: int | None = None) -> float:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(df, width=width).collect()
    cosine = x @ x.T
    np.fill_diagonal(cosine, 0)
    truth = (cosine >= 0.9).sum(axis=1)
    found = np.zeros(len(x), int)
    for r in got:
        found[r["vec_id"]] = r["n_links"]
    assert (found <= truth).all() and truth.sum() > 300
    return found.sum() / truth.sum()


@pytest.mark.parametrize("mean", [0.0, 0.8])
def test_recall_of_shifted_vectors(spark, mean):
    assert recall(spark, shifted(np.random.default_rng(3), mean)) >= 0.9


def test_recall_of_clusters_with_an_offset(spark):
    assert recall(spark, clusters(np.random.default_rng(4))) >= 0.9


def test_recall_of_wide_keys(spark):
    assert recall(spark, shifted(np.random.default_rng(5), 0.5), 16) >= 0.9


def test_doubles_beyond_floats(spark):
    rows = [(1, [1e-60, 0.0]), (2, [1e-60, 0.0]), (3, [3e-60, 1e-60]), (4, [0.0, 1e-300]), (5, [0.0, 1e300]), (6, [-1.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_string_ids_and_repeated_ids(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0]), ("c", [1.0, 0.0]), (None, [1.0, 0.0])]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<float>")).collect())
    assert got == Counter([("b", 2, "a", False), ("a", 2, "a", True), ("c", 0, "c", True), ("c", 2, "a", False), (None, 0, None, True)])
