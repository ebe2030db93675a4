"""URL filters and HTML extraction."""

from __future__ import annotations

import pytest

from rowloom.llm import html, urls

PAGES = [
    (1, "http://shop.net/a?x=1#y"), (2, "https://www.EXAMPLE.net/en/1"), (3, "https://example.com/de/"), (4, "https://a.b.org/fr/x?q"), (5, "https://a.b.org/en/"),
    (6, None), (7, ""), (8, "no url"), (9, "http://x.spam-farm.example.com/p"), (10, "http://notspam-farm.example.com/"), (11, "://cheap-pills.example.org"), (12, "http://net"),
    (13, "http://example.com/de"), (14, "http://É.Org/fr/://x.net/"), (1, "http://shop.net/a?x=1#y"), (None, "http://a..net/"),
]


def reference(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, verdict in urls.RULES:
        domain, _, prefix = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, verdict))
    rule, verdict = max(fits)[1:] if fits else (None, None)
    listed = any(host == k or host.endswith("." + k) for k in urls.LISTED)
    return host, path, rule, verdict or ("block" if listed else "allow")


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "k", 2) for i, u in PAGES], "page_id long, url string, key string, host int")
    listed = spark.createDataFrame([(k,) for k in (*urls.LISTED, urls.LISTED[0], None)], "key string")
    got = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, listed).where("page_id IS NOT NULL").collect())
    assert got == sorted(((i, *reference(u)) for i, u in PAGES if i is not None), key=lambda r: (r[0], r[1]))
    assert urls.judge_urls(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, listed.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many false positives, so many levels
    universe = spark.range(3000).selectExpr("concat('h', id) AS key")
    listed = universe.where("xxhash64(key) % 7 = 0").union(spark.range(50).selectExpr("concat('other', id) AS key"))
    cascade = urls.Cascade(listed, universe)
    assert len(cascade.levels) > 2
    judged = urls.with_levels(universe.union(listed).distinct(), cascade.levels).select("key", cascade.holds(urls.F.col("key")).alias("held"))
    assert {r["key"] for r in judged.where("held").collect()} == {r["key"] for r in listed.collect()}


def test_filters_beyond_the_literal_bound_are_met_shard_by_shard(spark, monkeypatch):
    monkeypatch.setattr(urls, "LITERAL_SHARDS", 0)
    monkeypatch.setattr(urls, "SHARD_BITS", 64)
    monkeypatch.setattr(urls, "BITS_PER_KEY", 4)
    universe = spark.range(3000).selectExpr("concat('h', id) AS key")
    listed = universe.where("xxhash64(key) % 7 = 0").union(spark.range(50).selectExpr("concat('other', id) AS key"))
    cascade = urls.Cascade(listed, universe)
    assert not cascade.literal and cascade.levels[0].shards > 20
    assert {r["key"] for r in cascade.listed(universe.union(listed).distinct()).collect()} == {r["key"] for r in listed.collect()}
    long = "x" * 20_000
    rows = [*PAGES, (20, f"http://spam-farm.example.com/{long}?{long}"), (21, f"http://{long}.spam-farm.example.com/")] + [(30, "http://hot.free-bets.example.com/")] * 500
    pages = spark.createDataFrame([(i, u, "k", 2) for i, u in rows], "page_id long, url string, key string, host int")
    names = spark.createDataFrame([(k,) for k in (*urls.LISTED, urls.LISTED[0], None)], "key string")
    got = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, names).where("page_id IS NOT NULL").collect())
    assert got == sorted(((i, *reference(u)) for i, u in rows if i is not None), key=lambda r: (r[0], r[1]))


def page(body, head="", around=""):
    return f'<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>var t="</p>";</script>{head}</head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>{around}<div class="ad">Buy it now for little money.</div><article>{body}</article><footer>&copy; Someone</footer></body></html>'


P = "<p>One two three four five six seven eight nine ten.</p>"
TEXT = "One two three four five six seven eight nine ten."


@pytest.mark.parametrize("source, want", [
    (page(f"<h1>Head &amp; line</h1>{P}"), f"Head & line\n{TEXT}"),
    (page(f"<h1>A</h1><p><b>soup<br><p>of  \n tags</b>{P}<ul><li>l1<li>l2</ul>{P}"), f"A\nsoup\nof tags\n{TEXT}\nl1\nl2\n{TEXT}"),
    (page(f"{P}<aside>side</aside><div class='social-share'>share</div><form>name <p>p</p></form><div id='comments'>{P * 3}</div>{P}"), f"{TEXT}\n{TEXT}"),
    (page(f"{P}<p>&lt;b&gt; &#233;&nbsp;x</p>", around=f"<header>{P}</header><div role='banner'>{P}</div><div class='cookie-notice'>{P}</div>"), f"{TEXT}\n<b> é x"),
    (page(P * 3, around="<p>short</p>"), "\n".join([TEXT] * 3)),
    (f"<div class='content with-sidebar'><p>{'word ' * 30}</p></div>", " ".join(["word"] * 30)),
    ("just text, a < b and c > d", "just text, a < b and c > d"),
    ("<p>tail <!-- never closed <p>hidden", "tail"),
    ("<script>only code", ""), ("", ""), (None, ""), ("<nav><p>unclosed menu of words</p>", "unclosed menu of words"),
])
def test_extraction(source, want):
    counts = html.label(page(f"<h1>T</h1>{P * 8}"))
    assert html.extract(source, html.weights(counts)) == want


def test_odd_pages_take_linear_time():
    weight = {}
    for source in ('<a "' * 20_000, "<" * 50_000, "<!--" * 20_000, "&" * 50_000):
        html.extract(source, weight)


def test_best_run():
    assert html.best_run([-1, 2, -1, 3, -9, 4, -5]) == (1, 4) and html.best_run([-1, 0.0]) == (0, 0) and html.best_run([]) == (0, 0)


def test_pages(spark):
    rows = [(i, f"u{i}", page(f"<h1>T{i}</h1>{P * (1 + i % 3)}"), 5) for i in range(20)] + [(20, None, None, 5), (21, "u", "", 5), (None, "n", page(P), 5), (3, "u3", page(P), 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract_pages(pages, html.fit(pages)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 4} == {f"T4\n{TEXT}\n{TEXT}"}
    assert {r["text"] for r in got if r["page_id"] in (20, 21)} == {""}
    assert html.extract_pages(pages.limit(0), html.fit(pages.limit(0))).count() == 0
