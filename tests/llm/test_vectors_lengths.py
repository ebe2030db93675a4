"""Vectors of several lengths: each length has its links."""

from __future__ import annotations

from rowloom.llm import vectors


def test_every_length_links_by_itself(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [0.0, -1.0]), (8, [2.0]), (9, None), (10, [1.0, 0.0, 0.0]), (11, [0.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 2, 1, False), (11, 0, 11, True),
    ]
