"""License scans against brute force."""

from __future__ import annotations

import re
from collections import Counter

from rowloom.llm import licences

MIT, GPL = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
TEXTS = [
    None, "", "\n \t\n", "licensed", "Prose and more.\nReleased under the MIT License.\nMore prose.", "released UNDER -- the mit license", "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Apache Licence, Version 2.0.", f"{MIT[1]}\n{GPL[0]}", MIT[1].replace(", ", ",\n"), "Released under the MIT License. " + "word " * 400, "released under the MIT License released under the MIT License",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "x " * 30_000, "Éclair\nThis work is licensed under the GNU General Public License, version 3.",
]


WRAPPED = "\n".join(MIT[0].split(" ")) + "\nand so on"
FULL = MIT[2].replace("following conditions: ", "following conditions:\n\n").replace(" included in\nall", " included in all")
TEXTS += [
    f"Some prose before it.\n{WRAPPED}", f"This file was written by me. {MIT[0]} See the notes at the end of it.", "Copyright 2020 Someone\n\n" + "\n".join(FULL[i : i + 70] for i in range(0, len(FULL), 70)),
    "\n".join(" ".join(GPL[2].split()[i : i + 11]) for i in range(0, len(GPL[2].split()), 11)) + "\n" + "code " * 500, "under the mit license license license license", "the the the of the", f"{GPL[0]} " * 300,
]


def grams(text):
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    return list(zip(w, w[1:]))


def dice(a, b):
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def brute(text):
    """Every template against all lines, the whole text and every window in which a bigram has its place."""
    lines, found = (text or "").split("\n"), []
    whole = grams(" ".join(lines))
    where = {}
    for i, g in enumerate(whole):
        where.setdefault(g, []).append(i)
    for licence, texts in licences.TEMPLATES.items():
        for b in map(grams, texts):
            starts = {i - j for j, g in enumerate(b) for i in where.get(g, ())}
            passages = [whole, *map(grams, lines), *(whole[max(s, 0) : s + len(b)] for s in starts)]
            score = max(dice(a, b) for a in passages)
            if score >= licences.THRESHOLD:
                found.append((score, licence))
    return len(found), ",".join(sorted({i for _, i in found})), max(found, default=(None, None))[1], max(found, default=(None, None))[0]


def test_templates_match_themselves(spark):
    texts = [(i, t, n) for n, ts in licences.TEMPLATES.items() for i, t in enumerate(ts)]
    got = licences.scan(spark.createDataFrame([(t, t) for _, t, _ in texts], "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["dice"] for r in got} == {t: 1.0 for _, t, _ in texts}
    assert all(n in r["licences"].split(",") for r in got for _, t, n in texts if t == r["doc_id"])


def test_scan(spark):
    rows = [(i, t, 1, "k") for i, t in enumerate(TEXTS)] + [(None, TEXTS[6], 1, "k"), (4, TEXTS[4], 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best int, found string")
    got = sorted((tuple(r) for r in licences.scan(docs).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 8 and licences.scan(docs.limit(0)).count() == 0
    assert all(r[1] == 0 for r in licences.scan(docs, templates={"X": ("nothing like this at all",)}).collect())
