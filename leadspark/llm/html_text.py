"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words and tags. Each token's score depends on its feature (words: the nearest enclosing
block and whether a link or a boilerplate container encloses it; tags: their name). Scores are log-odds of being inside
the main region, learned on a bounded sample of labelled pages: pages that mark their region with exactly one
`article` element. Words of content get positive scores, tags and boilerplate negative ones. One linear scan over the
page finds the contiguous run of tokens with the largest sum; it needs no marks. Blocks of the run that stand in
boilerplate containers (navigation, adverts, forms, comments, ...) are left out. A whole class word can name such a
container, but not the page's frame (html, body, main, article) or an element with more than half of the page's words.

Tokens are read in time linear in the page, however deep its elements nest: scripts and the like end at their own end
tag only, and each open element knows its block and the last of each name is at hand.

One Arrow pass over the pages and no shuffle; the sample is collected as a small table of feature counts.
"""

from __future__ import annotations

import html
import math
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import slices

#: Comments, declarations and tags. Quotes matter only behind an equals sign; one that is never closed is a character.
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
LABELS = {"class", "id", "role", "aria-label"}
#: Elements whose content is no text; those whose content has no tags but their own end; void elements; inline elements, which end no block; elements and class words of boilerplate.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "select", "canvas", "object"}
PLAIN = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ins", "del", "label"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Those that say so as a part of a hyphenated word too, unless another part turns the meaning; an `entry-header` holds the title.
BOILERPLATE_PARTS = BOILERPLATE_WORDS - {"header", "banner", "notice"}
TURNS = {"no", "not", "has", "with", "without", "is", "hide", "off"}
#: Elements that frame the content: class words say nothing about them.
FRAME = {"html", "body", "main", "article"}
REGION = "article"


class _Open:
    """An open element: mark numbers it if class words speak against it, block is the nearest block's name and wall the place of the nearest one but paragraphs on the stack, itself included."""

    __slots__ = ("name", "bad", "mark", "block", "wall")

    def __init__(self, name: str, bad: bool, mark: int, block: str, wall: int):
        self.name, self.bad, self.mark, self.block, self.wall = name, bad, mark, block, wall


def tokens(page: str) -> list[tuple[int, str, str, bool]]:
    """(kind, feature, text, region) in page order. kind 0: a piece of text; 1: a tag. region: inside a marked region."""
    spans: dict[int, list[int]] = {}
    found = list(_tokens(page, frozenset(), spans))
    if spans:
        words = [0, *accumulate(0 if kind else len(text.split()) for kind, _, text, _ in found)]
        large = frozenset(k for k, (begin, end) in spans.items() if 2 * (words[end] - words[begin]) > words[-1])
        if large:
            found = list(_tokens(page, large, {}))
    return found


def _says(word: str) -> bool:
    """Whether a class word names boilerplate, as a whole or in a part between hyphens or underscores."""
    if word in BOILERPLATE_WORDS:
        return True
    parts = word.replace("_", "-").split("-")
    return len(parts) > 1 and TURNS.isdisjoint(parts) and not BOILERPLATE_PARTS.isdisjoint(parts)


def _labelled(tag: str) -> bool:
    """Whether a word of the tag's class, id, role or label names boilerplate."""
    return any(any(map(_says, v.strip("\"'").lower().split())) for k, v in ATTRIBUTE.findall(tag) if k.lower() in LABELS)


def _tokens(page: str, large: frozenset[int], spans: dict[int, list[int]]):
    """tokens(); elements that class words mark are numbered by their tag's place, spans gets their tokens' range, large ones are not marked."""
    count = 0
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of open elements, by name
    unended: set[str] = set()
    at, skip = 0, ""
    block, bad, link, region = "", 0, 0, 0

    def close(i: int) -> None:
        nonlocal bad, link, region
        for o in stack[i:]:
            if o.mark >= 0:
                spans[o.mark][1] = count
            bad, link, region = bad - o.bad, link - (o.name == "a"), region - (o.name == REGION)
            places[o.name].pop()
        del stack[i:]

    while m := TAG.search(page, at):
        if m.start() > at and not skip:
            count += 1
            yield 0, ("x:" if bad else "a:" if link else "w:") + block, page[at : m.start()], region > 0
        at = m.end()
        tag = m[0]
        n = NAME.match(tag)
        if not n:
            continue
        name, closing = n[1].lower(), tag[1] == "/"
        if not closing and name in PLAIN and name not in unended:
            if end := PLAIN[name].search(page, at):
                at = end.start()
            elif name in ("script", "style"):
                at = len(page)
            else:
                unended.add(name)
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if not closing and name in RAW and not tag.endswith("/>") and name not in unended:
            skip = name
            count += 1
            yield 1, "t:" + name, "", region > 0
            continue
        if not closing:
            wrong = name in BOILERPLATE or (name == "header" and not region)
            mark = -1
            if not wrong and name not in FRAME and m.start() not in large and _labelled(tag):
                wrong, mark = True, m.start()
            if name in ("p", "li", "dd", "dt", "option") and places.get(name) and places[name][-1] >= stack[-1].wall:
                close(places[name][-1])  # a new one closes an open one
            if name == REGION:
                region += 1
            if name not in VOID and not tag.endswith("/>"):
                inline = name in INLINE
                over = stack[-1] if stack else None
                stack.append(_Open(name, wrong, mark, (over.block if over else "") if inline else name, (over.wall if over else -1) if inline or name == "p" else len(stack)))
                places.setdefault(name, []).append(len(stack) - 1)
                if mark >= 0:
                    spans[mark] = [count, count]
                bad, link = bad + wrong, link + (name == "a")
        count += 1
        yield 1, "t:" + name, "", region > 0
        if closing and places.get(name):
            close(places[name][-1])
        block = stack[-1].block if stack else ""
    if at < len(page) and not skip:
        count += 1
        yield 0, ("x:" if bad else "a:" if link else "w:") + block, page[at:], region > 0
    close(0)


def extract(page: str, weights: dict[str, float], tag_score: float, unseen: float = 0.5) -> str:
    """Text of the run of tokens with the largest sum of scores; of equal sums the first and longest run."""
    found = tokens(page)
    best = now = 0.0
    begin, run = 0, (0, 0)
    for i, (kind, feature, text, _) in enumerate(found):
        if kind:
            score = min(tag_score, weights.get(feature, tag_score))
        else:
            n = len(text.split())
            score = n * weights.get(feature, -1.0 if feature[0] != "w" else unseen)
        if now <= 0.0:
            now, begin = 0.0, i
        now += score
        if now > best:
            best, run = now, (begin, i + 1)
    parts: list[str] = []
    for kind, feature, text, _ in found[run[0] : run[1]]:
        if kind:
            if feature[2:] not in INLINE:
                parts.append(" ")
        elif feature[0] != "x":
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


def _counts(batches):
    import pyarrow as pa

    for batch in slices(batches, "html"):
        held: dict[tuple[str, bool], int] = {}
        for page in batch.column("html").to_pylist():
            if page and len(re.findall(r"<article[\s>]", page)) == 1 and "</article>" in page:
                for kind, feature, text, inside in tokens(page):
                    n = 1 if kind else len(text.split())
                    held[feature, inside] = held.get((feature, inside), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.bool_()), pa.array(list(held.values()), pa.int64())], ["feature", "inside", "n"])


def learn(pages: DataFrame, sample_pages: int = 5_000, least: int = 20) -> tuple[dict[str, float], float]:
    """Weights of features, and a tag's score, from the labelled pages of a seeded sample of about sample_pages pages."""
    total = pages.count()
    part = pages if total <= sample_pages else pages.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 20)) < int((1 << 20) * sample_pages / total))
    rows = part.select("html").mapInArrow(_counts, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()  # features are few
    counts: dict[str, list[int]] = {}
    for r in rows:
        counts.setdefault(r.feature, [0, 0])[r.inside] += r.n
    weights = {}
    for feature, (out, inside) in counts.items():
        odds = math.log((inside + 1) / (out + 1))
        if feature[0] == "t":
            weights[feature] = max(-1.5, min(-0.2, odds)) if feature[2:] not in INLINE | VOID else -0.05
        elif feature[0] == "x":
            weights[feature] = min(-1.0, odds)
        else:
            weights[feature] = max(-4.0, min(4.0, odds))
    return weights, -0.2


def _extract(model):
    def run(batches):
        import pyarrow as pa

        weights, tag_score = model.value
        for batch in slices(batches, "html"):
            texts = [extract(p, weights, tag_score) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def main_text(pages: DataFrame, model: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each of pages (page_id, url, html).

    A null or empty page, and one without a run of positive score, has an empty text. White space is Unicode's. Rows that repeat stay rows; an
    empty table gives none. Without labelled pages, words outside links and boilerplate score 0.5 and others -1.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = pages.sparkSession.sparkContext.broadcast(learn(pages) if model is None else model)  # a few hundred features
    return pages.mapInArrow(_extract(known), "page_id long, url string, text string, n_chars long")
