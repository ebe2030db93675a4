"""What labelled pages teach about classes, and the scan against all subsequences."""

from __future__ import annotations

import random
from collections import Counter

from test_pages import TEXT, P, page

from rowloom.llm import html


def learnt(*pages):
    total: Counter = Counter()
    for p in pages:
        total.update(html.label(p))
    return html.weights(total)


def test_best_run_against_all_runs():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-4, -1.5, -0.5, 0, 0.25, 1, 3]) for _ in range(rng.randrange(0, 14))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max([0, *sums.values()])
        start, end = html.best_run(scores)
        assert sum(scores[start:end]) == best and ((start, end) == (0, 0) or best > 0)


def test_labelled_pages_overrule_names():
    inside = "<section class='legal'><p>Article text under a heading on law, of some words.</p></section>"
    plain = learnt(*[page(f"<h1>T</h1>{P * 8}")] * 3)
    taught = learnt(*[page(f"<h1>T</h1>{P * 8}{inside * 3}")] * 3)
    want = f"{TEXT}\nArticle text under a heading on law, of some words.\n{TEXT}"
    assert html.extract(page(f"{P}{inside}{P}"), plain) == f"{TEXT}\n{TEXT}"
    assert html.extract(page(f"{P}{inside}{P}"), taught) == want


def test_classes_without_a_telling_name_are_learnt():
    junk = f"<div class='zk-teaser box'>{P * 3}</div>"
    body = f"<h1>T</h1>{P * 8}"
    taught = learnt(*[page(body, around=junk)] * 3)
    source = f"<html><body><div class='page'>{P * 4}{junk}{P * 4}</div></body></html>"
    assert html.extract(source, taught) == "\n".join([TEXT] * 8)


def test_comments_stay_out_whatever_pages_teach():
    inside = f"<div class='comments'>{P * 9}</div>"
    taught = learnt(*[page(f"<h1>T</h1>{P * 8}{inside}")] * 3)
    assert html.extract(page(f"{P}{P}{inside}"), taught) == f"{TEXT}\n{TEXT}"


def test_the_scan_decides_without_names():
    weight = learnt(*[page(f"<h1>T</h1>{P * 8}", around="<table><tr><td>cell</td></tr></table>" * 4)] * 3)
    links = "<ul>" + "<li><a href='/x'>link</a></li>" * 12 + "</ul>"
    source = f"<body>{links}<table><tr><td>one cell</td></tr></table>{P * 3}{links}</body>"
    assert html.extract(source, weight) == "\n".join([TEXT] * 3)
