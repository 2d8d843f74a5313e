"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier over tags, names, links and length gives
each block a cost, which becomes a capacity from the source (content) or to the sink
(boilerplate). Neighbouring blocks are joined by edges whose capacity falls with their distance
in the document tree. The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The classifier. Scores of tags and of words in class, id and role, inherited by all below.
TAG_SCORES = {
    "article": 3.0, "main": 2.0, "nav": -8.0, "footer": -8.0, "header": -7.0, "aside": -8.0, "form": -8.0, "menu": -8.0,
    "dialog": -8.0, "button": -6.0, "select": -6.0, "label": -4.0, "fieldset": -6.0, "address": -3.0,
}
BAD_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer dialog disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe tags toolbar topbar adsense gdpr widget".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())
BAD_WORD, GOOD_WORD = -8.0, 1.5
#: Names that begin so tell of something else on the page.
ABSENT = ("has-", "with-", "no-", "is-")
START, FOR_LENGTH, LENGTH_UNIT, MOST_LENGTH = -1.0, 1.0, 80, 3.0
LINKS, SENTENCE, HEADING = -5.0, 0.7, 0.5
#: The capacity between two blocks, divided by their distance in the tree.
SMOOTH = 2.0
#: Where that leaves no content at all: what is added to blocks that no container speaks against, and the capacity.
UNMARKED, LOOSE = 1.0, 0.5

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe svg math object canvas noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open element of these, up to a container.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
STOPS = frozenset("ul ol dl table tr select div article section body html nav aside footer header main form td th".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Character references by number: leading zeros, and numbers beyond all characters.
_ZEROS, _TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


class Block:
    __slots__ = ("text", "linked", "node", "inherited", "heading")

    def __init__(self, text: str, linked: int, node: int, inherited: float, heading: bool):
        self.text, self.linked, self.node, self.inherited, self.heading = text, linked, node, inherited, heading

    def score(self) -> float:
        n = len(self.text)
        score = START + self.inherited + min(MOST_LENGTH, FOR_LENGTH * n / LENGTH_UNIT) + LINKS * min(1.0, self.linked / n)
        return score + (SENTENCE if self.text[-1] in ".!?…。" else 0.0) + (HEADING if self.heading else 0.0)


class Tree:
    """The block elements of a page: each one's parent and depth; the page itself is 0."""

    def __init__(self) -> None:
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def distance(self, a: int, b: int) -> int:
        """Steps from one element to the other. Over neighbouring blocks they sum up to no more
        than the tags between them."""
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


class _Open:
    """The open elements, from the outside in, with what all below them inherit. Where the last
    element of a name is, is known without a search."""

    __slots__ = ("tags", "node", "score", "article", "heading", "at")

    def __init__(self) -> None:
        self.tags, self.node, self.score, self.article, self.heading = [""], [0], [0.0], [False], [False]
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, node: int, score: float) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.node.append(node)
        self.score.append(score)
        self.article.append(self.article[-1] or tag == "article")
        self.heading.append(self.heading[-1] or tag in HEADINGS)

    def last(self, tags: frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: frozenset[str], stops: frozenset[str]) -> None:
        """Close the last element of one of the tags and all in it, unless a stop is further in."""
        k = self.last(tags)
        if not k or k < self.last(stops):
            return
        while len(self.tags) > k:
            self.at[self.tags.pop()].pop()
        for x in (self.node, self.score, self.article, self.heading):
            del x[k:]


def _own_score(tag: str, attributes: str, inside_article: bool) -> float:
    score = TAG_SCORES.get(tag, 0.0)
    if tag == "header" and inside_article:
        score = -1.0
    if attributes and "=" in attributes:
        names = (n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split())
        words = {w for n in names if not n.startswith(ABSENT) for w in _WORD.findall(n)}
        if inside_article:
            words.discard("header")
        if words & BAD_WORDS and tag not in ("html", "body"):
            score += BAD_WORD
        elif words & GOOD_WORDS:
            score += GOOD_WORD
    return score


def decoded(text: str) -> str:
    """Character references as characters, white space as single spaces."""
    if "&#" in text:
        text = _TOO_LARGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return " ".join(html.unescape(text).split())


def _tags(page: str) -> Iterator[tuple[str, int, str, str]]:
    """``text, closing, name, attributes`` of each tag with the text before it; the last has no name.

    Comments, declarations and elements without text of the page are passed over. A tag ends at the
    first ``>`` outside quotes. If a quote is never closed, quotes no longer count from there on; a
    ``<`` behind the last ``>`` is text. So no part of the page is read more than twice.
    """
    at, end, last = 0, len(page), page.rfind(">")
    quotes = True
    begin = 0  # of the text not given yet
    skipped: list[str] = []  # text before what was passed over
    while True:
        at = page.find("<", at)
        if at < 0 or (at > last and not page.startswith("<!--", at)):
            break
        if page.startswith("<!--", at):
            skipped.append(page[begin:at])
            at = page.find("-->", at + 4) + 3
            begin = at = end if at == 2 else at
            continue
        m = _TAG.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                skipped.append(page[begin:at])
                begin = at = page.find(">", at) + 1
            else:
                at += 1
            continue
        close = _QUOTED.match(page, m.end()) if quotes else None
        quotes = quotes and close is not None
        stop = close.end() if close else page.find(">", m.end()) + 1
        tag, attributes = m[2].lower(), page[m.end() : stop - 1]
        yield "".join([*skipped, page[begin:at]]), bool(m[1]), tag, attributes
        skipped.clear()
        begin = at = stop
        if not m[1] and tag in RAW_TAGS and not (attributes.endswith("/") and tag in ("svg", "math")):
            found = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            begin = at = (page.find(">", found.start()) + 1 or end) if found else end
    yield "".join([*skipped, page[begin:]]), False, "", ""


def blocks_of(page: str) -> tuple[list[Block], Tree]:
    """The page's blocks in order, with white space made single and references decoded."""
    blocks: list[Block] = []
    tree, stack = Tree(), _Open()
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = decoded("".join(parts))
            parts.clear()
            if text:
                blocks.append(Block(text, links, stack.node[-1], stack.score[-1], stack.heading[-1]))
        links = 0

    for text, closing, tag, attributes in _tags(page):
        if text:
            parts.append(text)
            if in_link:
                links += len(text.strip())
        block = tag in BLOCK_TAGS
        if closing:
            if block:
                flush()
            if tag == "a":
                in_link = max(0, in_link - 1)
            stack.close(frozenset([tag]), frozenset() if block else BLOCK_TAGS)
        elif tag == "br":
            parts.append("\n")
        elif tag and tag not in RAW_TAGS:
            if block:
                flush()
                in_link = 0
                stack.close(frozenset(["p"]), STOPS)
                if tag in CLOSES:
                    stack.close(CLOSES[tag], STOPS - CLOSES[tag])
            if tag in VOID_TAGS:
                continue
            if tag == "a":
                in_link += 1
            above = stack.node[-1]
            stack.push(tag, tree.add(above) if block else above, stack.score[-1] + _own_score(tag, attributes, stack.article[-1]))
    flush()
    return blocks, tree


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    A positive cost is a capacity from the source, a negative one to the sink; ``edges`` are
    ``i, j, capacity`` both ways. Flow is pushed along shortest augmenting paths. Nodes from
    which the sink can no longer be reached never can again and are settled.
    """
    n = len(costs)
    rest: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        rest[i][j] = rest[i].get(j, 0) + c
        rest[j][i] = rest[j].get(i, 0) + c
    supply, demand = [max(c, 0) for c in costs], [max(-c, 0) for c in costs]
    settled = [False] * n
    for source in range(n):
        while supply[source] and not settled[source]:
            came, queue, sink = {source: source}, deque([source]), -1
            while queue and sink < 0:
                i = queue.popleft()
                for j, c in rest[i].items():
                    if c and j not in came and not settled[j]:
                        came[j] = i
                        if demand[j]:
                            sink = j
                            break
                        queue.append(j)
            if sink < 0:
                for i in came:
                    settled[i] = True
                break
            path = [sink]
            while path[-1] != source:
                path.append(came[path[-1]])
            flow = min(supply[source], demand[sink], *(rest[b][a] for a, b in zip(path, path[1:])))
            supply[source] -= flow
            demand[sink] -= flow
            for a, b in zip(path, path[1:]):
                rest[b][a] -= flow
                rest[a][b] += flow
    return settled


def smoothness(blocks: list[Block], tree: Tree, smooth: float = SMOOTH) -> list[tuple[int, int, int]]:
    """Edges between neighbours, and between a block and the next one below the same parent; their
    capacity falls with the distance in the tree."""
    edges, last = [], {}
    capacity = lambda i, k: round(100 * smooth / max(1, tree.distance(blocks[i].node, blocks[k].node)))
    for k, b in enumerate(blocks):
        parent = tree.parent[b.node]
        if k:
            edges.append((k - 1, k, capacity(k - 1, k)))
        if last.get(parent, k) < k - 1:
            edges.append((last[parent], k, capacity(last[parent], k)))
        last[parent] = k
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by two line feeds.

    A page whose containers don't tell where its content is may have all its blocks labelled as boilerplate,
    for their neighbours' sake or as too short. It is labelled once more, with the benefit of the doubt for
    blocks that no container speaks against, and with less weight on neighbours.
    """
    blocks, tree = blocks_of(page or "")
    if not blocks:
        return ""
    content = min_cut([round(100 * b.score()) for b in blocks], smoothness(blocks, tree))
    if not any(content):
        doubt = [UNMARKED if b.inherited >= 0 and 2 * b.linked < len(b.text) else 0.0 for b in blocks]
        content = min_cut([round(100 * (b.score() + d)) for b, d in zip(blocks, doubt)], smoothness(blocks, tree, LOOSE))
    return "\n\n".join(b.text for b, keep in zip(blocks, content) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return ``page_id, url, text, n_chars`` for every row of ``pages``.

    Null and empty pages, and pages without content, have an empty text. Pages may be of any length
    and nested in any way: each takes time by its length. Repeated rows, null ids and null URLs are
    kept; an empty table gives an empty result; other columns are ignored, whatever their names.
    """

    @F.pandas_udf("string")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(main_text).astype(object)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(text_of(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
