"""The pipeline, stage by stage, against a plain version of each; and the registered queries."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from conftest import SCHEMA, prose
from test_groups import brute_fingerprint, brute_targets, lowest
from test_texts import WORD, brute_counts, brute_ratio, brute_repeats

import corpus_pipeline
from rowloom.llm import pieces, queries, rules, simhash


def rows():
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(40, 160)) for _ in range(40)]
    texts[1] = texts[0]
    texts[3] = texts[2] + " x"
    passage = prose(rng, 50)
    for i in (5, 6, 7):
        texts[i] = f"{texts[i]}\n{passage}\t{prose(rng, 30)}\n"
    for i in (10, 11, 12):
        texts[i] = " ".join(w.upper() + "!!" for w in texts[i].split())
    texts[13], texts[14], texts[15] = None, "", "too short"
    return [(i, t, "en", "big" if i % 3 else "small", len(t or "")) for i, t in enumerate(texts)]


def rules_stage(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    ratio = brute_ratio([d[1] for d in docs], [d[0] in good for d in docs])
    out = []
    for d, r in zip(docs, ratio):
        n, _, _, _, repeats = brute_counts(d[1])
        if n >= 50 and 100 * repeats <= 50 * n and r >= rules.THRESHOLD:
            out.append(d)
    return out


def simhash_stage(docs):
    prints = [brute_fingerprint(d[1]) for d in docs]
    label = lowest(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.NEAR_BITS])
    return [docs[i] for i in sorted(set(label.values()))]


def substring_stage(docs):
    _, gone = brute_repeats([d[1] for d in docs], 35)
    out = []
    for d, g in zip(docs, gone):
        found = list(WORD.finditer(d[1]))
        ends = [m.start() for m in found[1:]] + [len(d[1])]
        text = (d[1][: found[0].start()] if found else d[1]) + "".join(d[1][m.start() : e] for m, e, x in zip(found, ends, g) if not x)
        out.append((*d[:1], text, *d[2:4], len(text)))
    return out


def mix_stage(docs):
    size = lambda d: len(WORD.findall(d[1]))
    by_source = defaultdict(list)
    for d in docs:
        by_source[d[3]].append(d)
    sums = {s: sum(map(size, ds)) for s, ds in by_source.items()}
    out = []
    for s, target in brute_targets(sums).items():
        budget = int(target + 0.5)
        epochs, rest = divmod(budget, sums[s])
        before = 0
        for d in sorted(by_source[s], key=lambda d: hashlib.md5(f"mix-1:{d[0]}:{hashlib.md5(d[1].encode()).hexdigest()}".encode()).hexdigest()):
            extra = before + size(d) <= rest or before < rest and 2 * (rest - before) >= size(d)
            out += [d] * (epochs + extra)
            before += size(d)
    return out


def encode_stage(docs):
    sp = pieces.vocabulary(queries.piece_model()).library
    return [(d[0], d[2], d[3], sp.encode(d[1], add_eos=True)) for d in docs]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = rows()
    labels = [(i, int(i not in (10, 11)), 0) for i in range(0, 40, 2)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = [lambda d: rules_stage(d, labels), simhash_stage, substring_stage, mix_stage, encode_stage]
    key = lambda r: repr(tuple(r))
    counts, given = [len(docs)], docs
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        out = stage(spark, spark.createDataFrame(given, SCHEMA), str(tmp_path))
        want = brute(given)
        if name == "sentencepiece":
            assert sorted(map(key, out.select("doc_id", "lang", "source", "token_ids").collect())) == sorted(map(key, want))
            run = corpus_pipeline.run(spark, str(tmp_path))
            assert sorted(map(key, run.select("doc_id", "lang", "source", "token_ids").collect())) == sorted(map(key, want))
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(key, out.collect())) == sorted(map(key, want)), name
        counts.append(len(want))
        given = want
    assert counts[0] > counts[1] > counts[2] == counts[3]


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("the driver's tables are not there")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(map(repr, cursor.fetchall()))
    ours = queries.QUERIES[name](spark, small)
    assert sorted(ours.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in ours.select(*names).collect()) == theirs
