"""Article content that shares its names with boilerplate stays."""

from __future__ import annotations

import pytest
from test_pages import TEXT, P, page

from rowloom.llm import html


@pytest.mark.parametrize("body, want", [
    (f"{P}<figure><img src='x'><figcaption>What the figure shows.</figcaption></figure>{P}", f"{TEXT}\nWhat the figure shows.\n{TEXT}"),
    (f"{P}<p>As <math><mi>x</mi><mo>&lt;</mo><mn>1</mn><annotation encoding='application/x-tex'>x \\lt 1</annotation></math> holds.</p>{P}", f"{TEXT}\nAs x<1 holds.\n{TEXT}"),
    (f"{P}<h2 id='related-work'>Related work</h2>{P}", f"{TEXT}\nRelated work\n{TEXT}"),
    (f"{P}<section id='search'><h2 id='legal'>Search</h2>{P}</section>{P}", f"{TEXT}\nSearch\n{TEXT}\n{TEXT}"),
    (f"{P}<div class='search-methods legal_history'>{P}</div>{P}", "\n".join([TEXT] * 3)),
    (f"{P}<div class='box related'>{P}</div><section class='share-widget'>{P}</section><div role='search'>{P}</div><div id='comments'>{P}</div>{P}", f"{TEXT}\n{TEXT}"),
])
def test_article_keeps_its_content(body, want):
    weight = html.weights(html.label(page(f"<h1>T</h1>{P * 8}")))
    assert html.extract(page(body), weight) == want


def test_outside_an_article_names_still_mark():
    weight = html.weights(html.label(page(f"<h1>T</h1>{P * 8}")))
    around = f"<div class='related-posts'>{P}</div><section id='search-methods'>{P}</section><figure><figcaption>Caption</figcaption></figure>"
    assert html.extract(page(P * 3, around=around), weight) == "\n".join([TEXT] * 3)
