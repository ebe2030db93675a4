"""Mixing where rows share ids, where one source is hot, and where there are many sources."""

from __future__ import annotations

from fractions import Fraction

from rowloom.llm import mixing
from tests.llm.conftest import SCHEMA


def shares(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: Fraction(cap * sizes[s]) for s in names}
        level = Fraction(sum(sizes.values()) - sum(cap * sizes[s] for s in capped), sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: Fraction(cap * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= over


def near_targets(got: list) -> None:
    by_source: dict = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    wanted = shares({s: sum(r["size"] for r in rows) for s, rows in by_source.items()})
    for s, rows in by_source.items():
        assert abs(rows[0]["target"] - float(wanted[s])) < 1e-6 * max(1, wanted[s])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        longest = max(r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - wanted[s]) <= max(1, longest), s


def test_rows_without_ids_and_with_one_id(spark):
    rows = [(None, " ".join(["w"] * (10 + i)) + f" {i}", "en", "a", 1) for i in range(50)]
    rows += [(7, " ".join(["v"] * (1 + i % 9)) + f" {i}", "en", "b", 1) for i in range(100)]
    rows += [(100 + i, " ".join(["u"] * 30) + f" {i}", "en", "c", 1) for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 250
    near_targets(got)


def test_equal_rows_share_what_is_left(spark):
    rows = [(1, "one two three four", "en", "a", 1)] * 200 + [(1000 + i, "x " * 20, "en", "b", 1) for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    taken = {r["taken"] for r in got if r["source"] == "a"}
    assert len(taken) == 1
    wanted = shares({"a": 800, "b": 1000})
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - wanted["a"]) <= 200


def test_hot_source_and_many_sources(spark):
    rows = [(i, "w " * (1 + i % 13), "en", "hot" if i % 3 == 0 else f"host{i % 400}" if i % 5 else None, 1) for i in range(6000)]
    near_targets(mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect())


def test_ranks(spark):
    names = ["b", "a", None, "ä", "Z", "z", "\U0001f600", "￿"]
    got = {r["source"]: r["rank"] for r in mixing.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")).collect()}
    wanted = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: i for i, n in enumerate(wanted)}
