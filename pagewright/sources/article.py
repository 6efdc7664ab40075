"""The main content of a parsed page: paragraphs give points to what holds them, and links take points away.

One walk over the tree measures every element (characters, characters in links, commas), from the leaves up, without
recursion. A paragraph of SHORTEST characters or more has points for its length and commas; the element around it gets
them all, each one further out half as many. An element's rank is its points, and what its tag and its names say, times
the share of its text that isn't in links. The best element, or the only part of it with paragraphs, is the article's core;
its neighbours join if they rank well or are prose themselves, and lists of links inside it go.

A page counts as readable if it has enough long paragraphs outside lists; a page that doesn't, or whose article is shorter
than LEAST characters, has no article.
"""

from __future__ import annotations

from collections.abc import Callable

SHORTEST, LONG, READABLE, LEAST, LEVELS = 25, 140, 20.0, 200, 4
#: Share of its text in links above which an element is navigation, and share of the best rank that lets a neighbour join.
LINKED, JOINS = 0.5, 0.2
#: Share of an element's text outside links with which its only part with paragraphs takes its place.
MOST = 2 / 3
PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd"}
CONTAINERS = {"div", "section", "article", "main", "center"}
BLOCK_KIDS = PARAGRAPHS | CONTAINERS | {"table", "li", "ul", "ol", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "figure"}
NEVER = {"aside", "button", "select", "textarea", "object", "embed", "menu"}
TAG_POINTS = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "pre": 2.0, "ul": -4.0, "ol": -4.0, "dl": -4.0, "li": -4.0, "th": -6.0, "address": -4.0, "body": -2.0}
# Words in class names and ids that speak for and against content.
FOR = {"article", "body", "content", "entry", "main", "page", "post", "story", "text", "blog"}
AGAINST = {"ad", "ads", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "footer", "header", "links", "menu", "meta", "nav", "navbar", "navigation", "newsletter", "pager", "pagination", "popup", "promo", "recommended", "related", "share", "sidebar", "social", "sponsor", "sponsored", "tags", "teaser", "toolbar", "widget"}
NAME_POINTS = 20.0


def names(node) -> set[str]:
    words = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return set("".join(c.lower() if c.isalnum() else " " for c in words).split()) if words != " " else set()


class Measured:
    """Elements of a page in document order with what they hold; parts that are noise are left out."""

    def __init__(self, root, noise: Callable):
        self.nodes, self.parent, todo = [], [], [(root, -1)]
        while todo:
            node, up = todo.pop()
            todo.extend((kid, len(self.nodes)) for kid in reversed(node.kids) if not isinstance(kid, str) and kid.tag not in NEVER and not noise(kid))
            self.nodes.append(node)
            self.parent.append(up)
        self.own = [len(" ".join("".join(k for k in node.kids if isinstance(k, str)).split())) for node in self.nodes]
        n = len(self.nodes)
        self.chars, self.links, self.commas, self.blocks, self.items = [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
        for i in range(n - 1, -1, -1):  # an element comes after its parent, so its own sums are complete here
            node = self.nodes[i]
            self.chars[i] += self.own[i]
            self.commas[i] += sum(k.count(",") + k.count("，") + k.count("、") for k in node.kids if isinstance(k, str))
            if node.tag == "a" and node.attrs.get("href"):
                self.links[i] = self.chars[i]
            self.items[i] += node.tag == "li"
            if (up := self.parent[i]) >= 0:
                for held in (self.chars, self.links, self.commas, self.items):
                    held[up] += held[i]
                self.blocks[up] |= node.tag in BLOCK_KIDS or (self.blocks[i] and node.tag not in BLOCK_KIDS)

    def prose(self, i: int) -> bool:
        """Whether an element is a paragraph, or a container that holds text and no blocks."""
        tag = self.nodes[i].tag
        return tag in PARAGRAPHS and not (tag == "td" and self.blocks[i]) or tag in CONTAINERS and not self.blocks[i] and self.chars[i] > 0

    def free_of_links(self, i: int) -> float:
        return 1 - self.links[i] / self.chars[i] if self.chars[i] else 0.0

    def within(self, i: int, tags: set[str]) -> bool:
        while i >= 0 and self.nodes[i].tag not in tags:
            i = self.parent[i]
        return i >= 0


def ranks(page: Measured) -> dict[int, float]:
    """Rank of every element that a paragraph gives points to."""
    points: dict[int, float] = {}
    for i in range(len(page.nodes)):
        if not page.prose(i) or page.chars[i] < SHORTEST:
            continue
        given, up = 1.0 + page.commas[i] + min(page.chars[i] // 100, 3), page.parent[i]
        for _ in range(LEVELS):
            if up < 0:
                break
            points[up] = points.get(up, 0.0) + given
            given, up = given / 2, page.parent[up]
    out = {}
    for i, p in points.items():
        node = page.nodes[i]
        said = names(node)
        p += TAG_POINTS.get(node.tag, 0.0) + NAME_POINTS * (bool(said & FOR) - bool(said & AGAINST))
        out[i] = p * page.free_of_links(i)
    return out


def readable(page: Measured) -> bool:
    return sum((page.chars[i] - LONG) ** 0.5 for i in range(len(page.nodes)) if page.prose(i) and page.chars[i] > LONG and not page.within(page.parent[i], {"li"}) and page.free_of_links(i) > LINKED) >= READABLE


def is_navigation(page: Measured, i: int) -> bool:
    """A part of an article that leads elsewhere: mostly links, or named so and short of prose."""
    node, said = page.nodes[i], names(page.nodes[i])
    if node.tag not in CONTAINERS and node.tag not in ("ul", "ol", "dl", "table"):
        return False
    linked = 1 - page.free_of_links(i) if page.chars[i] else 0.0
    if said & AGAINST and not said & FOR:
        return linked > LINKED / 2 or page.chars[i] < LEAST
    return linked > LINKED and (page.items[i] > 1 or page.chars[i] < LEAST)


def only_part(page: Measured, rank: dict[int, float], i: int) -> int | None:
    """The one part of an element that holds paragraphs, if it has most of the text: beside it are single lines and lists.

    Points of a paragraph are bounded, so a few lines with commas, like a notice and a footer, outdo long prose without any.
    """
    kids = [k for k in range(i + 1, len(page.nodes)) if page.parent[k] == i]
    if any(page.nodes[k].tag in PARAGRAPHS and page.chars[k] >= SHORTEST for k in kids):
        return None
    held = [k for k in kids if k in rank]
    if len(held) != 1 or page.nodes[held[0]].tag not in CONTAINERS:
        return None
    return held[0] if page.chars[held[0]] - page.links[held[0]] > MOST * (page.chars[i] - page.links[i]) else None


def main_content(root, noise: Callable, make: Callable) -> tuple[object, str] | None:
    """(an element that holds the article's parts, its first paragraph), or None if the page has no article.

    `noise(node)` tells what never counts, `make(tag, attrs, parent)` builds an element. The page's tree isn't changed.
    """
    page = Measured(root, noise)
    if not readable(page):
        return None
    rank = ranks(page)
    if not rank:
        return None
    best = max(rank, key=lambda i: (rank[i], -i))
    while page.parent[best] >= 0 and page.nodes[best].tag not in CONTAINERS:  # paragraphs left open hold the ones after them
        best = page.parent[best]
    while (held := only_part(page, rank, best)) is not None:
        best = held
    # What stands around the best element may be better as a whole: a container of several parts that all rank well.
    up = page.parent[best]
    while up > 0 and page.nodes[up].tag in CONTAINERS and rank.get(up, 0.0) > 0.75 * rank.get(best, 0.0) and page.chars[up] - page.links[up] > 1.5 * (page.chars[best] - page.links[best]):
        best, up = up, page.parent[up]
    least = max(10.0, JOINS * rank.get(best, 0.0))
    around = [i for i in range(len(page.nodes)) if page.parent[i] == page.parent[best]] if page.parent[best] >= 0 else [best]
    parts = []
    for i in around:
        free, said = page.free_of_links(i), names(page.nodes[i])
        alone = page.nodes[i].tag == "p" and page.chars[i] > 80 and free > 1 - LINKED / 2
        if i == best or not said & AGAINST and (rank.get(i, 0.0) >= least or alone or page.nodes[i].tag in ("h1", "h2") and i < best):
            parts.append(i)
    copies: dict[int, object] = {}
    top = make("div", {}, None)
    for i in range(len(page.nodes)):  # in document order, so a parent comes before what it holds
        up = page.parent[i]
        if i in parts or up in copies and not is_navigation(page, i):
            copies[i] = make(page.nodes[i].tag, page.nodes[i].attrs, top if i in parts else copies[up])
    if sum(page.own[i] for i in copies) < LEAST:
        return None
    of = {id(page.nodes[i]): copy for i, copy in copies.items()}
    for i, copy in copies.items():
        copy.kids = [kid if isinstance(kid, str) else of[id(kid)] for kid in page.nodes[i].kids if isinstance(kid, str) or id(kid) in of]
    top.kids = [copies[i] for i in parts]
    first = next((page.nodes[i].text() for i in copies if page.prose(i) and page.chars[i] >= SHORTEST), "")
    return top, first
