"""Connected components of a distributed edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node sends its larger (large) or smaller neighbours, and itself, to the smallest of them."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("c"), F.least("a", "least").alias("least"))
    joined = around.join(least, F.col("a") == F.col("c"))
    if large:
        sent = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        sent = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).where(F.col("a") != F.col("b")).union(least.select(F.col("c").alias("a"), F.col("least").alias("b")))
    return sent.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Each round writes its edges to the shared checkpoint folder. The rounds end when a pass changes nothing: the edges
    are then stars around the smallest nodes. No edges give no rows; loops (a = b) and repeated edges change nothing.
    """
    edges, seen = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        edges, seen = cut(_star(_star(edges, True), False)), state
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return stars.union(edges.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 that takes links in arrays; each class is labelled with its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            if not (other := x != y).any():
                return
            a, b, x, y = a[other], b[other], x[other], y[other]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped
