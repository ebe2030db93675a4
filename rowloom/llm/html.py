"""HTML extraction by the maximum-scoring subsequence of a page's words and tags.

Every word scores at least zero, by the block it stands in; every tag scores at most zero, by its name. The weights are
log odds of standing inside or outside the article, counted over labelled pages. One scan finds the contiguous run of
tokens with the largest sum. Elements that are foreign to articles score nothing, so that a run neither grows into them nor
breaks at them, and are left out of its text. Menus, forms, sidebars, comments and adverts are foreign by their names; all
other classes and roles by the log odds of the words in them, with a few words counted beforehand against those that seldom
mark article text (search, related and the like).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import prepare

#: Pages with an article element that the weights are counted on, at most: those of least hash.
MAX_LABELLED = 5_000
#: Bounds of the score of a word and of a tag.
WORD_CAP, TAG_CAP, TAG_LEAST = 2.0, 4.0, 0.1
#: Score of words in blocks that labelled pages say nothing about.
UNKNOWN_WORD = 0.1
#: Score of tags that they don't have, but for those inside lines, which score -TAG_LEAST.
UNKNOWN_TAG = -1.0

RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "canvas")
OMITTED = {"head", "title", "nav", "footer", "aside", "form", "button", "dialog", "menu", "audio", "video", "figcaption"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
#: Words of a class, id or role that mark what is never article text, and those that labelled pages may overrule.
_NEVER = r"ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|comment-?list|cookies?|consent|contentinfo|disqus|footer|gdpr|login|masthead|menu|nav|navbar|navigation|newsletter|pagination|popups?|replies|responses|sidebars?|signup|sponsor(?:ed|s)?|subscribe"
_SELDOM = r"legal|modal|notices?|promos?|promotion|related|search|share|sharing|social|toolbar|widgets?"
_MARK, _NOT = rf"(?:{_NEVER}|{_SELDOM})", r"(?<!\bhas-)(?<!\bwith-)(?<!\bno-)"
#: A part of a name marks an element outside an article; inside, the name must have no other words.
_PART = re.compile(rf"(?:^|[_-]){_NOT}{_MARK}(?:$|[_-])")
_WHOLE = re.compile(rf"{_MARK}(?:[_-]{_MARK})*")
_STRICT = re.compile(rf"(?:^|[_-]){_NOT}(?:{_NEVER})(?:$|[_-])")
#: Words outside the article that count beforehand against a name that seldom marks article text (other names need as many
#: words before they count), and the log odds below which an element is foreign.
PRIOR_WORDS, FOREIGN = 20, -1.5
#: Inside an article the ids of these are what links point at.
_TITLED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_KNOWN = BLOCKS | VOID | INLINE
_ANNOTATION = re.compile(r"<(annotation(?:-xml)?)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)


def _formula(source: str) -> str:
    """The text of a formula, without the notes that aren't shown."""
    return unescape(_TAG.sub("", _ANNOTATION.sub("", source)))


def _marks(name: str, attributes: str, titled: bool) -> Iterator[tuple[bool, str]]:
    """(whether it can be learnt, name) of the classes and roles of an element, and of its id."""
    for kind, *values in _MARKS.findall(attributes):
        if not (titled and kind.lower() == "id"):
            for mark in next(filter(None, values), "").lower().split():
                yield kind.lower() != "id", mark


def foreign(name: str, attributes: str, within: list[str], weight: dict[tuple[str, str], float] | None) -> bool:
    """Whether an element is foreign to articles; without weights only names that are so always count."""
    if name in ("html", "body", "main"):
        return False
    inside = "article" in within
    if name in OMITTED and not (inside and name == "figcaption") or name == "header" and not inside and "main" not in within:
        return True
    for learnt, mark in _marks(name, attributes, inside and name in _TITLED):
        if name == "article":
            if mark.startswith("comment"):
                return True
            continue
        marked = (_WHOLE.fullmatch if inside else _PART.search)(mark)
        if marked and _STRICT.search(mark):
            return True
        if weight is not None:
            counts = [weight.get((where, mark), 0.0) if learnt else 0.0 for where in ("inside", "outside")]
            if (marked or sum(counts) >= PRIOR_WORDS) and np.log((counts[0] + 0.5) / (counts[1] + 0.5 + (PRIOR_WORDS if marked else 0))) < FOREIGN:
                return True
    return False


def tokens(html: str, weight: dict[tuple[str, str], float] | None = None) -> list[tuple[str, str, int]]:
    """Tokens (kind, value, words): tags, texts (value: decoded, with the block it stands in before a tab) and texts of
    foreign elements; kind is "<", "</", "t" or "-". Without weights, as labelled pages are counted, the classes and roles
    of the blocks around follow the name of the block."""
    out: list[tuple[str, str, int]] = []
    at, block, skipped, depth = 0, "body", "", 0
    blocks: list[str] = []
    marks: list[tuple[str, ...]] = []
    lower = None

    def text(upto: int) -> None:
        if upto > at:
            body = unescape(html[at:upto])
            if n := len(body.split()):
                around = "" if weight is not None else "".join(f" {m}" for m in {m for each in marks for m in each})
                out.append(("-", body, n) if skipped else ("t", f"{block}{around}\t{body}", n))
            elif not skipped:
                out.append(("t", f"{block}\t ", 0))

    last = html.rfind(">")
    while at <= last and (m := _TAG.search(html, at)):
        text(m.start())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if skipped:
            if name == skipped:
                depth += -1 if closing else 1
                if not depth:
                    skipped = ""
                    out.append(("</", name, 0))
            continue
        out.append(("</" if closing else "<", name, 0))
        if closing:
            if name in blocks:
                while blocks.pop() != name:
                    marks.pop()
                marks.pop()
                block = blocks[-1] if blocks else "body"
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if name == "math" and end and "article" in blocks:
                body = _formula(html[at : end.start()])
                out[-1] = ("t", f"{block}\t{body}", len(body.split()))
            else:
                out.append(("</", name, 0))
            at = end.end() if end else len(html)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if foreign(name, attributes, blocks, weight):
                if lower is None:
                    lower = html.lower()
                if lower.find(f"</{name}", at) >= 0:
                    skipped, depth = name, 1
            elif name in BLOCKS:
                if name == "p" and blocks and blocks[-1] == "p":
                    blocks.pop()
                    marks.pop()
                blocks.append(name)
                marks.append(tuple(m for learnt, m in _marks(name, attributes, False) if learnt) if weight is None else ())
                block = name
    if last >= 0 and (m := re.compile(r"<!--", re.S).search(html, at)):  # an open comment hides the rest
        html = html[: m.start()]
    text(len(html))
    return out


def _name(name: str) -> str:
    return name if name in _KNOWN else "other"


def label(html: str) -> Counter | None:
    """Counts of (kind, name, inside) of a page that labels its article with one element of that name; else None."""
    found = tokens(html)
    ends = [i for i, t in enumerate(found) if t[1] == "article" and t[0] in ("<", "</")]
    if len(ends) != 2 or found[ends[0]][0] != "<":
        return None
    counts: Counter = Counter()
    for i, (kind, value, n) in enumerate(found):
        inside = ends[0] < i < ends[1]
        if kind == "t":
            block, *around = value.partition("\t")[0].split(" ")
            counts["word", block, inside] += n
            for mark in around:
                counts["mark", mark, inside] += n
        elif kind in ("<", "</"):
            counts["tag", _name(value), inside] += 1
    return counts


def weights(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Scores of words by block, at least 0, and of tags by name, at most 0; and the words inside and outside articles by
    the classes and roles around them."""
    out = {("inside" if k[2] else "outside", k[1]): float(n) for k, n in counts.items() if k[0] == "mark"}
    for kind, name in {k[:2] for k in counts if k[0] != "mark"}:
        odds = np.log((counts.get((kind, name, True), 0) + 0.5) / (counts.get((kind, name, False), 0) + 0.5))
        out[kind, name] = min(WORD_CAP, max(0.0, odds)) if kind == "word" else -min(TAG_CAP, max(TAG_LEAST, -odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the first contiguous run with the largest sum above 0; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def whole_blocks(found: list[tuple[str, str, int]], start: int, end: int) -> tuple[int, int]:
    """A run widened to the tags of blocks around it, so that no block is cut."""
    edge = lambda t: t[0] == "-" or t[0] != "t" and t[1] in BLOCKS
    while 0 < start < end and not edge(found[start - 1]):
        start -= 1
    while start < end < len(found) and not edge(found[end]):
        end += 1
    return start, end


def extract(html: str | None, weight: dict[tuple[str, str], float]) -> str:
    """The main text of a page: its blocks joined by line ends."""
    if not html:
        return ""
    found = tokens(html, weight)
    scores = []
    for kind, value, n in found:
        if kind == "t":
            scores.append(n * weight.get(("word", value.partition("\t")[0]), UNKNOWN_WORD))
        else:
            scores.append(0.0 if kind == "-" else weight.get(("tag", _name(value)), -TAG_LEAST if value in INLINE else UNKNOWN_TAG))
    start, end = whole_blocks(found, *best_run(scores))
    blocks, current = [], []
    for kind, value, _ in found[start:end]:
        if kind == "t":
            current.append(value.partition("\t")[2])
        elif value in BLOCKS:
            blocks.append("".join(current))
            current = []
        elif value == "br":
            current.append(" ")
    blocks.append("".join(current))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> dict[tuple[str, str], float]:
    """Weights from at most MAX_LABELLED of the pages that have an article element; those with several are passed over."""
    prepare(pages.sparkSession)
    ids = pages.where(F.col(html).cast("string").rlike(r"(?i)<article[\s>]")).select(F.col(page_id).alias("__id")).where("__id IS NOT NULL").distinct().orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED)
    chosen = pages.join(F.broadcast(ids), F.col(page_id) == F.col("__id")).select(F.col(html).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(label(page) or ()) if page else None
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.string()), pa.array([r[0][2] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64())], ["kind", "name", "inside", "n"])

    counted = chosen.mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["kind"], r["name"], r["inside"]): r["n"] for r in counted.collect()})


def extract_pages(pages: DataFrame, weight: dict[tuple[str, str], float], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page, or one without words, has an empty text. Repeated rows give a row each; an empty table gives
    none. Other columns of ``pages``, whatever their names, are not read.
    """
    prepare(pages.sparkSession)
    id_type = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x and x.decode("utf-8", "replace"), weight) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"))
    return chosen.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
