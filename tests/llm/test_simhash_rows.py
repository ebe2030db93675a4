"""SimHash where one prefix holds all fingerprints, and where rows share ids."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from rowloom.llm import simhash
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_groups import lowest


@pytest.mark.parametrize(("shared", "n"), [(24, 3000), (52, 2500)])
def test_one_prefix_holds_all_fingerprints(spark, shared, n):
    rng = random.Random(9)
    top = rng.getrandbits(shared) << (64 - shared)
    prints = {top | rng.getrandbits(64 - shared) for _ in range(n // 2)}
    for seed in list(prints)[: n // 8]:
        for k in (1, 2, 3, 4):
            flipped = seed
            for bit in rng.sample(range(64 - shared), min(k, 64 - shared)):
                flipped ^= 1 << bit
            prints.add(flipped)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.near_links(df, hot=200).collect()]
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert all(((a ^ b) % (1 << 64)).bit_count() < 64 - shared + 1 for a, b in edges)
    assert lowest(signed, edges) == lowest(signed, links)


def test_every_class_keeps_one_row(spark):
    rng = random.Random(3)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (6, c, "en", "s", 1), (6, c, "en", "t", 1), (None, d, "en", "s", 1), (None, d, "en", "s", 1), (None, a, "en", "s", 1), (7, c, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    assert Counter(kept) == Counter([(5, a), (5, b), (6, c), (None, d)])
    again = [tuple(r) for r in simhash.keep_one(df.repartition(5)).collect()]
    assert Counter(again) == Counter(tuple(r) for r in simhash.keep_one(df).collect())


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "one two three four"), ("c", "quite another text here")], "doc_id string, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {("a", "a"), ("b", "a"), (None, "a"), ("c", "c")}
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == {"a", "c"}


def test_columns_of_clashing_names_stay(spark):
    rng = random.Random(5)
    a, b = prose(rng, 60), prose(rng, 60)
    names = ["fp", "row", "own", "first", "component", "node", "trail", "value", "id", "none"]
    rows = [(i, t, *([i] * len(names))) for i, t in enumerate([a, b, a, a])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` long" for n in names)]))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows[:2])
