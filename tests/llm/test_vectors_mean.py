"""Recall of the embedding tables where all vectors share a direction."""

from __future__ import annotations

import numpy as np
import pytest

from rowloom.llm import vectors


def embeddings(rng, norm, n, d=64):
    """n unit vectors whose mean has about the norm, and a partner of each at cosines about 0.9."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    mean, u, w = np.eye(d)[0], unit(rng.standard_normal((n, d))), unit(rng.standard_normal((n, d)))
    near = max(0.0, (0.91 - norm**2) / (1 - norm**2))
    v = near * u + np.sqrt(1 - near**2) * w
    rest = np.sqrt(1 - norm**2)
    return unit(norm * mean + rest * u), unit(norm * mean + rest * v)


@pytest.mark.parametrize("width, rows", [(8, 10_000), (12, 1 << 21), (16, 1 << 27)])
@pytest.mark.parametrize("norm", [0.0, 0.8, 0.9, 0.96])
def test_recall_with_a_common_mean(norm, width, rows):
    rng = np.random.default_rng(5)
    index = vectors.learn(np.concatenate(embeddings(rng, norm, 1000)), rows)
    assert index.width == width
    x, y = embeddings(rng, norm, 4000)
    near = (x * y).sum(axis=1) >= 0.9
    a, b = index.codes(x[near]), index.codes(y[near])
    shared = index.keys(a) == index.keys(b)
    within = np.repeat(np.bitwise_count(a ^ b) <= index.radius, index.tables, axis=1)
    assert near.sum() > 500 and (shared & within).any(axis=1).mean() >= 0.9
