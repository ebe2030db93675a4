"""SimHash, embeddings, components and mixing against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import document_rows
from test_texts import WORD, norm

from rowloom.llm import mixing, simhash, vectors
from rowloom.llm.components import components


def lowest(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = lowest({x for e in links if e[0] != e[1] for x in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = WORD.findall(lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_equals_brute_force(docs, clashing, empty):
    rows = document_rows()
    prints = [brute_fingerprint(r[1]) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter((r[0], p) for r, p in zip(rows, prints))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = lowest(range(len(rows)), links)
    groups = defaultdict(list)
    for i, l in label.items():
        groups[l].append(rows[i][0])
    want = Counter((rows[i][0], min((d for d in groups[l] if d is not None), default=None)) for i, l in label.items())
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert norm(simhash.near_duplicates(clashing), "doc_id", "component_id") == norm(simhash.near_duplicates(docs), "doc_id", "component_id")
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(groups) and set(ids) == {c for _, c in want}


@pytest.mark.parametrize("hot", [simhash.HOT, 5])
def test_trie_join_finds_every_link(spark, hot):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for seed in list(prints)[:40]:
        for _ in range(12):
            flipped = seed
            for _ in range(rng.randrange(1, 6)):
                flipped ^= 1 << rng.randrange(64)
            prints.add(flipped)
    prints |= {1 << i for i in range(40)} | {0, (1 << 64) - 1}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.near_links(df, hot=hot).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 64 for a, b in edges)
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    assert lowest(signed, edges) == lowest(signed, links)


def test_frontier_is_worked_off_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    n = np.array([len(values)])
    got = {(int(a), int(b)) for x, y in simhash.join_tries(values, (np.array([0]), n, np.array([0]), n), 0, 3) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 3}
    assert got == want


# 8


def vector_rows(rng, centres=25, each=8, d=24):
    rows = []
    for _ in range(centres):
        c = rng.standard_normal(d)
        for _ in range(each):
            rows.append((c + rng.standard_normal(d) * rng.uniform(0, 0.6)).astype(np.float32).tolist())
    rows += [rows[3], rows[3], [2 * x for x in rows[5]]]
    odd = [None, [], [0.0] * d, [None] * d, [float("nan")] * d, [float("inf")] * d, [1.0] * 5]
    return rows, odd


@pytest.mark.parametrize("block", [vectors.BLOCK, 16])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows, odd = vector_rows(np.random.default_rng(2))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows + odd)] + [(None, rows[0], 1)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    x = np.array(rows, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    links = [(i, j) for i in range(len(x)) for j in range(i) if cosine[i, j] >= 0.9]
    degree = Counter(k for e in links for k in e)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert len(got) == len(rows) + len(odd) + 1 and found >= 0.9 * 2 * len(links) and len(links) > 100
    assert all(got[i]["n_links"] <= degree[i] for i in range(len(x)))  # none below the threshold
    for i in range(len(rows), len(rows) + len(odd)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0
    label = lowest(range(len(x)), links)
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) > 0.9
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for i, r in got.items() if i is not None)


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b
    index = vectors.learn(a, 1000)
    ka, kb, ca, cb = index.keys(index.codes(a)), index.keys(index.codes(b)), index.codes(a), index.codes(b)
    near = np.bitwise_count(ca ^ cb) <= index.radius
    hit = ((ka == kb) & np.repeat(near, index.tables, axis=1)).any(axis=1)
    assert hit.mean() >= 0.9


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()[0]["kept"]
    one = vectors.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [-1.0])], schema))
    assert {r["vec_id"]: r["component_id"] for r in one.collect()} == {1: 1, 2: 1, 3: 3}


# 9


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        target = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **target}
        fixed.update({s: cap * sizes[s] for s in over})


def test_mixing(spark, docs, clashing, empty):
    rows = document_rows()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = brute_targets(size)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sums = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
    assert all(abs(sums[s] - want[s]) <= 1 for s in want)
    assert norm(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken") == norm(docs.sparkSession.createDataFrame(got), "doc_id", "size", "taken")
    assert norm(mixing.mix(clashing), "doc_id", "taken") == norm(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mix(empty).count() == 0
    made = mixing.materialize(clashing)
    assert made.columns == clashing.columns
    longest = max(len(WORD.findall(r[1] or "")) for r in rows)
    total = defaultdict(int)
    for r in made.collect():
        total[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert all(abs(total[s] - want[s]) <= longest / 2 + 1 for s in want)


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 1, "b": 1000}, {"a": 0, "b": 7, None: 9}, {"a": 0}, {chr(97 + i): i * i + 1 for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got.keys() == sizes.keys()
    for s, t in (brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)).items():
        assert got[s] == pytest.approx(t)


def test_ranges_of_many_digits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 9 AS INT)) AS text", "IF(id < 400, 'big', 'small') AS source")
    got = mixing.mix(docs).collect()
    for s in ("big", "small"):
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5)
