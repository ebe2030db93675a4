"""Encoding, rules, classifier and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import document_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import discriminant, pieces, queries, rules, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def norm(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1


def test_encoding_equals_the_library(docs, clashing, empty):
    sp = pieces.vocabulary(queries.piece_model()).library
    outputs = tuple(pieces.OUTPUTS)
    found = pieces.tokenize(docs, queries.piece_model(), outputs=outputs).collect()
    assert len(found) == len(document_rows())
    by_text = Counter()
    for r in found:
        by_text[r["doc_id"], r["decoded"]] += 1
        ids = sp.encode(r["decoded"], add_eos=True)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and not r["n_corrected"]
        assert r["ids_sha256"] == sha(" ".join(map(str, ids))) and r["decoded_sha256"] == sha(sp.decode(ids))
    assert by_text == Counter((i, t or "") for i, t, *_ in document_rows())
    assert norm(pieces.tokenize(clashing, queries.piece_model(), keep=("doc_id", "fp"), outputs=("n_tokens",)), "doc_id", "n_tokens") == norm(pieces.tokenize(docs, queries.piece_model(), check=False), "doc_id", "n_tokens")
    assert pieces.tokenize(empty, queries.piece_model()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab the\n\t▁éß日①x.,!<s>0\U0001F600"), max_size=200))
def test_encoder_on_odd_texts(text):
    vocab = pieces.vocabulary(queries.piece_model())
    (ids, corrected), = pieces.Encoder(vocab).encode([text])
    assert ids.tolist() == vocab.library.encode(text, add_eos=True) and not corrected
    assert vocab.decode(ids.tolist()) == vocab.library.decode(ids.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_decoding_any_ids(ids):
    vocab = pieces.vocabulary(queries.piece_model())
    assert vocab.decode(ids) == vocab.library.decode(ids)


def test_long_chunks_use_the_heap_and_tables_are_dropped(monkeypatch):
    vocab = pieces.vocabulary(queries.piece_model())
    monkeypatch.setattr(pieces, "KEPT", 3)
    encoder = pieces.Encoder(vocab)
    for text in ("the" * 400, "a b c d e f", "a b c d e f g"):
        (ids, _), = encoder.encode([text])
        assert ids.tolist() == vocab.library.encode(text, add_eos=True)


# 3


def brute_counts(text):
    found = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = {w for w, k in Counter(windows).items() if k > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def brute_ratio(texts, trusted):
    def grams(text):
        b = text.encode()
        for n in rules.ORDERS:
            for i in range(len(b) - n + 1):
                yield ((int.from_bytes(b[i : i + n], "big") ^ (n * 0x51ED27)) * 0x9E3779B1 % (1 << 32)) >> 16

    raw, good = Counter(), Counter()
    for t, ok in zip(texts, trusted):
        found = list(grams(t or ""))
        raw.update(found)
        good.update(found if ok else ())
    share = sum(good.values()) / max(1, sum(raw.values()))
    out = []
    for t in texts:
        found = list(grams(t or ""))
        out.append(sum(np.log((good[k] + rules.SMOOTHING) / (raw[k] * share + rules.SMOOTHING)) for k in found) / len(found) if found else 0.0)
    return out


def test_rules_equal_brute_force(spark, docs, clashing, empty):
    trusted = spark.createDataFrame([(i,) for i in (*range(20), 20, 21, 21, 999)] + [(None,)], "doc_id long")
    rows = document_rows()
    found = defaultdict(list)
    for r in rules.quality_rules(docs, trusted).collect():
        found[r["doc_id"]].append(r)
    short = [i for i, r in enumerate(rows) if len(r[1] or "") < 3000]
    ratio = brute_ratio([r[1] for r in rows], [r[0] is not None and r[0] <= 21 for r in rows])
    for i, (doc, text, *_) in enumerate(rows):
        counts = brute_counts(text)
        same = [r for r in found[doc] if tuple(r)[1:6] == counts]
        assert same, (doc, counts, found[doc])
        if i in short:
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            assert any(r["base_failed"] == failed and abs(r["llr"] - ratio[i]) < 1e-9 and r["kept"] == (not failed and r["llr"] >= rules.THRESHOLD) for r in same)
    assert norm(rules.quality_rules(clashing, trusted), "doc_id", "llr", "kept") == norm(rules.quality_rules(docs, trusted), "doc_id", "llr", "kept")
    assert rules.quality_rules(empty, trusted).count() == 0
    nothing = rules.quality_rules(docs, trusted.limit(0)).collect()
    assert all(r["llr"] == 0 and r["kept"] == (not r["base_failed"]) for r in nothing)


def test_all_trusted_documents_count(spark):
    docs = spark.range(20_500, numPartitions=4).selectExpr("id AS doc_id", "substr(sha2(string(id), 256), 1, 12) AS text")
    assert np.abs(rules.fit(docs, docs)).max() < 1e-9
    half = docs.where("doc_id >= 500")
    raw, good = (Counter(k for t in df.toPandas()["text"] for b in rules.grams(t.encode()) for k in b.tolist()) for df in (docs, half))
    want, share = np.zeros(rules.BUCKETS), sum(good.values()) / sum(raw.values())
    for k in raw:
        want[k] = np.log((good[k] + rules.SMOOTHING) / (raw[k] * share + rules.SMOOTHING))
    assert np.abs(rules.fit(docs, half) - want).max() < 1e-9


def test_only_kept_documents_pass(docs, clashing):
    kept = rules.judge(clashing, np.zeros(rules.BUCKETS), keep=tuple(clashing.columns), only_kept=True)
    assert kept.columns == clashing.columns
    want = rules.judge(docs, np.zeros(rules.BUCKETS)).where("kept").select("doc_id")
    assert norm(kept, "doc_id") == norm(want, "doc_id")


def test_repeated_words_of_many_different_words():
    found = [b"%d" % i for i in range(5000)] * 2
    assert rules.repeated_words(found) == 10_000 and rules.repeated_words(found[:5000]) == 0


# 4


def junk(rng):
    return " ".join(rng.choice(["BUY!!", "NOW!!", "###", "a|b", "$$$", "|"]) for _ in range(rng.randrange(1, 200)))


def test_classifier_on_held_out_documents(spark, clashing, empty):
    rng = random.Random(5)
    rows = [(i, (junk(rng) if i % 4 == 0 else " ".join(rng.choice(["river", "stone", "over", "the", "a", "hill."]) for _ in range(rng.randrange(1, 300)))), int(i % 4 > 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(9000, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in discriminant.classify(docs, labels).collect()}
    assert len(found) == 803 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    held = [(found[i]["score"], q) for i, _, q in rows if found[i]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    flipped = spark.createDataFrame([(i, q if not found[i]["held_out"] else 1 - q) for i, _, q in rows], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in discriminant.classify(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in found.items()}  # held-out labels are never used
    assert all(r["score"] == 0.5 for r in discriminant.classify(docs, labels.limit(0)).collect())
    assert discriminant.classify(empty, labels).count() == 0
    assert discriminant.classify(clashing, labels).columns == ["doc_id", "held_out", "score", "predicted"]


# 7


def brute_repeats(texts, k):
    found = [WORD.findall(t or "") for t in texts]
    where = Counter(tuple(w[i : i + k]) for w in found for i in range(len(w) - k + 1))
    out = []
    for w in found:
        gone = {i + j for i in range(len(w) - k + 1) if where[tuple(w[i : i + k])] > 1 for j in range(k)}
        out.append([i in gone for i in range(len(w))])
    return found, out


@pytest.mark.parametrize("k, m", [(35, 8), (5, 2), (3, 3), (1, 1)])
def test_substrings_equal_brute_force(docs, clashing, empty, k, m):
    rows = document_rows()
    found, gone = brute_repeats([r[1] for r in rows], k)
    want = sorted(((r[0], len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for r, w, g in zip(rows, found, gone)), key=repr)
    got = substrings.substring_dedup(docs, window=k, anchor=m)
    assert norm(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    if k == 35:
        assert norm(substrings.substring_dedup(clashing), "doc_id", "n_removed") == norm(got, "doc_id", "n_removed")
        assert substrings.substring_dedup(empty).count() == 0
        with_spans = substrings.substring_dedup(docs, spans=True).collect()
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in with_spans)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words_that_repeat_a_lot(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, gone = brute_repeats(texts, 9)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.substring_dedup(docs, window=9, anchor=3).collect()}
    assert got == {i: sum(g) for i, g in enumerate(gone)}


def test_cut_texts_keep_their_white_space(docs):
    rows = {(r["doc_id"], r["text"]) for r in substrings.without_repeats(docs).collect()}
    original = document_rows()
    found, gone = brute_repeats([r[1] for r in original], 35)
    for (doc, text, *_), w, g in zip(original, found, gone):
        if text is not None and not any(g):
            assert (doc, text) in rows
    kept = {(d, tuple(WORD.findall(t or ""))) for d, t in rows}
    assert kept == {(r[0], tuple(x for x, y in zip(w, g) if not y)) for r, w, g in zip(original, found, gone)}
    assert substrings.cut_words(b"a  b c\n d e", [b"a", b"b", b"c", b"d", b"e"], np.array([0, 1, 1, 0, 0], bool)) == b"a  d e"
