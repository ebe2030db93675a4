"""Substring dedup where hashes collide, and with ids that are null, repeated or no numbers."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from rowloom.llm import substrings
from tests.llm.conftest import prose


def brute(texts: list, k: int) -> list:
    """(words, words removed, digest) of each text by comparing all windows."""
    split = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def rows_with_repeats(rng: random.Random) -> list:
    texts = [prose(rng, rng.randrange(20, 120)) for _ in range(60)]
    passages = [prose(rng, 50) for _ in range(4)]
    for i in range(0, 30):
        texts[i] = f"{texts[i]} {passages[i % 4]} {prose(rng, 15)}"
    texts[40] = texts[41]
    texts[42] = f"{passages[0]} x {passages[0]}"
    texts[43] = passages[1][5:-40]
    rows = [(None if i % 3 else f"id{i % 7}", t) for i, t in enumerate(texts)]
    return [*rows, rows[50], rows[50], rows[2], (None, None), ("", "")]


@pytest.mark.parametrize("bits", [9, 14, 64])
def test_words_decide_not_hashes(spark, bits):
    rows = rows_with_repeats(random.Random(bits))
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.substring_dedup(docs, window=12, anchor=4, hash_bits=bits).collect())
    want = Counter((r[0], *b) for r, b in zip(rows, brute([t for _, t in rows], 12)))
    assert got == want and sum(n for (_, _, n, _), c in got.items()) > 500


def test_many_texts_without_an_id(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9000)) for _ in range(40)) for _ in range(3000)]
    rows = [(None, t) for t in texts] + [(None, t) for t in texts[::3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(docs).collect())
    assert got == Counter({(40, 40): 2000, (40, 0): 2000})


def test_columns_of_clashing_names_stay(spark):
    rng = random.Random(5)
    passage, alone = prose(rng, 60), prose(rng, 60)
    names = ["doc", "tag", "anchor", "path", "place", "places", "own", "set", "code", "n_words"]
    rows = [(i, t, *([i] * len(names))) for i, t in enumerate([passage, alone, f"{passage} more", None])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` long" for n in names)]))
    made = substrings.without_repeats(df)
    got = {r["doc_id"]: tuple(r) for r in made.collect()}
    assert made.columns == df.columns and got[1] == rows[1] and got[3] == rows[3]
    assert (got[0][1], got[2][1]) == ("", "more") and got[0][2:] == rows[0][2:]
