"""Main text of web pages by tag-path ratios (after Wu et al., 2013)."""

from __future__ import annotations

import html
import os
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glowtrace.llm.common import small_batches

#: Weights of the neighbours' ratios in page order, and the share of the page's fused mean that a content path reaches.
SMOOTH, LEAST = np.array([0.06, 0.24, 0.4, 0.24, 0.06]), 0.5
#: The only article or main of a page is the container if it holds this share of the content text.
HOLDS = 0.7
#: Elements nested deeper count as their parent, as in browsers.
DEPTH = 512

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>|<[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td blockquote figure details dl ol ul".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset(
    "address aside caption dd dialog dt fieldset figcaption footer form header hgroup hr legend li menu nav p pre summary tfoot th thead".split()
)
#: Blocks that belong to the content node next to them, however short they are.
ITEMS = frozenset("li dt dd td th caption figcaption pre blockquote".split())
#: Containers that are parts of an article, never all of it.
PARTS = frozenset("ul ol dl menu table blockquote figure".split())
#: What an opening tag closes first, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements, parts of class names or ids, and roles that never hold the article.
OUTSIDE = frozenset("head nav footer aside form fieldset button menu dialog label".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Of these, words that are common in articles' own names as well ("related-work"): they count alone, or with a word of the
#: second set ("related-posts").
AMBIGUOUS = frozenset("banner comment comments menu modal navigation notice pager promoted recommended related replies reply respond share sharing social widget".split())
PARTNERS = OUTSIDE_NAMES | frozenset(
    "area articles bar block box btn button buttons container content count feed footer form group header icon icons inner item items left links list main media more "
    "news outer panel posts right section stories this thread top user users wrap wrapper".split()
)
#: Those of readers' texts, which can be longer than the article.
READER_NAMES = frozenset("comment comments disqus replies reply respond".split())
#: An element with a name from these lists is the article's all the same if it holds this share of the page's fused ratios.
MOST, MOST_OF_READERS = 0.5, 0.9
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu navigation search".split())


@dataclass
class Node:
    """An open or closed element. ``block`` is the nearest one that breaks lines; ``side`` the outermost element inside that
    one, if any, that is marked as no article or named so: its text is told apart from the block's."""

    tag: str
    up: Node | None
    outside: bool
    path: str
    hidden: bool = False
    names: frozenset[str] = frozenset()
    chain: tuple[int, ...] = ()
    text: list[str] = field(default_factory=list)
    block: Node = field(init=False)
    side: Node | None = field(init=False)

    def __post_init__(self) -> None:
        own = self.tag in BLOCKS or self.up is None
        self.block = self if own else self.up.block
        marked = not own and (bool(self.names) or (self.outside and not self.up.outside))
        self.side = None if own else self.up.side or (self if marked else None)


def _node(tag: str, attrs: str, up: Node) -> Node:
    """An element with what its tag, role and style say of it; ``names`` are its words of OUTSIDE_NAMES, judged with the text."""
    hidden, names = up.hidden, set()
    outside = up.outside or tag in OUTSIDE or (tag == "header" and not re.search(r"/(article|main)\b", up.path))
    for name, *values in _ATTRIBUTE.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
        elif name == "role" and value.lower() in OUTSIDE_ROLES:
            outside = True
        elif name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            for word in value.split():
                parts = {p.lower() for p in _PARTS.findall(word)}
                hits = parts & OUTSIDE_NAMES
                names |= set() if hits <= AMBIGUOUS and not parts - hits <= PARTNERS else hits
    return Node(tag, up, outside or hidden, f"{up.path}/{tag}", hidden, frozenset(names))


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements in page order, and the blocks of text as (element, text)."""
    root = Node("", None, False, "")
    nodes, stack, found = [root], [root], []
    root.chain = (0,)
    run: list[str] = []
    sides: list[Node] = []
    owner = root

    def keep(owner: Node, parts: list[str]) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text:
            found.append((owner, text))
        parts.clear()

    def flush() -> None:
        keep(owner, run)
        for side in sides:
            keep(side, side.text)
        sides.clear()

    def say(text: str) -> None:
        nonlocal owner
        side = stack[-1].side
        if side is not None:
            if not side.text:
                sides.append(side)
            side.text.append(text)
            return
        if not run:
            owner = stack[-1].block
        run.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            say(" ") if run or stack[-1].side else None
            continue
        if tag in BLOCKS:
            flush()
        if m["end"]:
            if any(n.tag == tag for n in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        closes, bound = CLOSES.get(tag, (set(), set()))
        if tag in BLOCKS:
            closes = closes | {"p"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in closes:
                del stack[i:]
                break
            if stack[i].tag in bound or stack[i].tag in CONTAINERS and stack[i].tag not in closes:
                break
        if tag in VOID or len(stack) > DEPTH:
            continue
        up = stack[-1]
        node = _node(tag, m["attrs"] or "", up)
        node.chain = (*up.chain, len(nodes))
        nodes.append(node)
        stack.append(node)
    say(page[at:])
    flush()
    return nodes, found


def fused_ratios(candidates: list[tuple[Node, str]]) -> np.ndarray:
    """For each block the product of two ratios of its path, text length a block and punctuation a block, both smoothed over
    the blocks in page order."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in candidates:
        length[node.path] += len(text)
        marks[node.path] += len(_PUNCTUATION.findall(text))
        count[node.path] += 1
    wide = len(SMOOTH) // 2

    def smooth(of: dict[str, int]) -> np.ndarray:
        series = np.array([of[n.path] / count[n.path] for n, _ in candidates], float)
        weight = np.convolve(np.ones(len(series)), SMOOTH, "full")[wide : wide + len(series)]
        return np.convolve(series, SMOOTH, "full")[wide : wide + len(series)] / weight

    return smooth(length) * (1 + smooth(marks))


def content_paths(candidates: list[tuple[Node, str]]) -> set[str]:
    """Paths whose mean fused ratio reaches the threshold."""
    fused, total, count = fused_ratios(candidates), defaultdict(float), defaultdict(int)
    for (node, _), x in zip(candidates, fused, strict=True):
        total[node.path] += x
        count[node.path] += 1
    return {p for p in total if total[p] / count[p] >= LEAST * fused.mean()}


def article_candidates(nodes: list[Node], found: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The blocks that may be the article's: not in an element that never holds one, nor in one that is named like that.

    A name doesn't count on an element with most of the page's fused ratios, or with an article or main while none lies
    outside all such elements. If no block is left, names count for nothing; if still none is, all that is shown is taken.
    """
    open_ = [(n, t) for n, t in found if not n.outside]
    if not open_:
        return [(n, t) for n, t in found if not n.hidden]
    named = {i for n, _ in open_ for i in n.chain if nodes[i].names}
    if not named:
        return open_
    share, total = defaultdict(float), 0.0
    inner, plain = set(), False
    for (node, _), x in zip(open_, fused_ratios(open_), strict=True):
        total += x
        inside = [i for i in node.chain if i in named]
        for i in inside:
            share[i] += x
        mark = next((i for i in node.chain if nodes[i].tag in ("article", "main")), None)
        if mark is not None:
            around = [i for i in inside if i < mark]
            inner.update(around)
            plain |= not around
    for i in list(named):
        least = MOST_OF_READERS if nodes[i].names & READER_NAMES else MOST
        if share[i] >= least * total or (i in inner and not plain):
            named.discard(i)
    return [(n, t) for n, t in open_ if named.isdisjoint(n.chain)] or open_


def container(nodes: list[Node], content: list[tuple[Node, str]]) -> int:
    """The innermost container of all content blocks that is not inside a list, table, quote or figure; a table's cell is one
    if it holds all blocks and there are several, as in a layout. An article or main around it, or a page's only one if it
    holds most of the content, is the container instead."""
    common = os.path.commonprefix([n.chain for n, _ in content])
    at = 0
    for k, i in enumerate(common):
        cell = nodes[i].tag == "table" and len(content) > 1 and any(nodes[j].tag in ("td", "th") for j in common[k:])
        if nodes[i].tag in PARTS and not cell:
            break
        at = i if nodes[i].tag in CONTAINERS else at
    for tag in ("article", "main"):
        holder = next((i for i in nodes[at].chain if nodes[i].tag == tag), None)
        if holder is not None:
            return holder
    for tag in ("article", "main"):
        marked = [i for i, n in enumerate(nodes) if n.tag == tag and not n.outside]
        if len(marked) == 1 and sum(len(t) for n, t in content if marked[0] in n.chain) >= HOLDS * sum(len(t) for _, t in content):
            return marked[0]
    return at


def selected(inside: list[tuple[Node, str]], chosen: set[str]) -> list[tuple[Node, str]]:
    """The content nodes of a container, those on content paths, with what stands between the first and the last of them, the
    headings and items before and the items after."""
    at = [i for i, (n, _) in enumerate(inside) if n.path in chosen]
    if not at:
        return inside
    first, last = at[0], at[-1]
    while first and inside[first - 1][0].tag in HEADINGS | ITEMS:
        first -= 1
    while last + 1 < len(inside) and inside[last + 1][0].tag in ITEMS:
        last += 1
    return inside[first : last + 1]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty if there is none: the content nodes of the container, by their paths, also where
    the page itself marks an article or main."""
    nodes, found = blocks(page or "")
    candidates = article_candidates(nodes, found)
    if not candidates:
        return ""
    chosen = content_paths(candidates)
    at = container(nodes, [(n, t) for n, t in candidates if n.path in chosen])
    inside = [(n, t) for n, t in candidates if at in n.chain and not (n.tag != "h1" and "/header" in n.path and n.tag not in HEADINGS)]
    inside = selected(inside, chosen)
    titles = [x for x in candidates if x[0].tag == "h1" and at not in x[0].chain]
    if len(titles) == 1 and not any(n.tag == "h1" for n, _ in inside):
        inside = titles + inside
    return "\n".join(t for _, t in inside)


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return extract(F.coalesce(page.cast("string"), F.lit("")))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for pages (page_id, url, html), rows as they come.

    Elements are read once into blocks of text with their root-to-leaf tag paths; menus, headers, footers, sidebars,
    notices, adverts, forms, comments, scripts and styles are known by element, class, id or role, of which a name counts
    only where ``article_candidates`` lets it, inside a line as well. The fused ratios of the rest's paths, thresholded, give
    the content nodes and their container. Null or empty html, or a page without text: empty text. Null or repeated ids and
    urls are returned as they are. Empty table: empty result.
    """
    small_batches(pages.sparkSession)
    found = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
