"""Documents with everything that operators must stand: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "to", "in", "river", "stone", "Éclair", "naïve", "x", "running", "quite"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice("aeiou") * rng.randrange(3)) + str(rng.randrange(50) if rng.random() < 0.3 else "") for _ in range(n))


def document_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(1, 300)) for _ in range(n)]
    texts[3], texts[4], texts[5], texts[6] = None, "", " \n\t ", "one"
    texts[7] = texts[8]
    texts[9] = texts[10].replace("alpha", "alphas", 1)
    passage = prose(rng, 60)
    for i in (11, 12, 13):
        texts[i] = f"{texts[i]}\n{passage} {prose(rng, 40)}"
    texts[14] = prose(rng, 9000)
    texts[15] = " ".join(["again"] * 200)
    texts[16] = "no\x0bbreak here 　 wide " + "w" * 5000
    texts[17] = "\n".join([prose(rng, 12)] * 8)
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[20], (21, "another text under an id that is taken", "en", "s0", 3), (None, texts[22], "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with more columns, under names that operators use themselves."""
    more = ["fp", "component", "component_id", "size", "key", "target", "taken", "kept", "n_words", "anchor", "path", "place", "text_", "x", "score", "label", "id", "copies", "vector", "column", "value"]
    out = docs
    for m in more:
        out = out.selectExpr("*", f"1 AS `{m}`")
    return out


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
