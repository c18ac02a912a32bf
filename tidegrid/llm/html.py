"""Main-text extraction by gradient-boosted trees over DOM nodes with hierarchical decoding."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start of one of these ends an open p.
ENDS_P = BLOCK - frozenset("dd dt li td th tr tbody thead tfoot summary legend".split())
#: What a start of the key ends among the open ones, up to the next holder.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "body": ("head",)}
HOLDERS = frozenset("ul ol menu dl table html body div section article aside nav header footer main form td th".split())
#: Never text of a page.
HIDDEN = frozenset("script style noscript template iframe noframes textarea title head select option button svg math object audio video canvas datalist".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: The same for the rest of a page in which a quote is never closed.
_BROKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

# Tokens of class, id and role names that pages use for parts that are not the article, and for it.
AWAY = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments contact cookie cookies consent copyright dialog disqus download extra feedback filter footer form gdpr header hidden legal login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popular popup privacy promo promoted recommend recommended related reply replies respond rss search share sharing shop shoutbox sidebar sidebox signup skip skyscraper social sponsor sponsored subscribe taboola tag tags teaser toc toolbar tooltip trending user warning widget".split())
TOWARDS = frozenset("article articlebody blog body content contents entry hentry main maincontent page post postbody story storybody text".split())
#: Of the former, those that mark a part inside a line of text.
AWAY_IN_LINE = frozenset("ad ads advert advertisement adverts hidden newsletter promo promoted share social sponsor sponsored subscribe".split())
#: A run of text and inline elements that stands beside blocks directly in a page, its body or an inline element with blocks in it.
RUN = "#run"
_SECTIONS = ("article", "main", "section", "div", "p", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "figure", "blockquote", "pre", "heading", "other", "run", "inline")


class Node:
    """An element: name, attribute words, parent, depth, children and texts in page order."""

    __slots__ = ("name", "attrs", "parent", "depth", "children", "order", "n_text", "n_link", "n_words", "n_punct", "n_blocks", "links", "items")

    def __init__(self, name: str, attrs: str, parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.items: list[Node | str] = []
        if parent:
            parent.children.append(self)
            parent.items.append(self)


def parse(html: str) -> Node:
    """A tree of every page, however broken: unknown ends are passed over, open elements end with their holder."""
    root = node = Node("#root", "", None)
    at = text_from = 0
    n, last, broken = len(html), html.rfind(">") + 1, False
    while (p := html.find("<", at, last)) >= 0:
        m = None if broken else _TAG.match(html, p, last)
        if m is None and (m := _BROKEN.match(html, p, last)):
            broken = True  # a quote is open to the page's end; that is found out once
        if m is None:
            at = p + 1
            continue
        if p > text_from:
            node.items.append(html[text_from:p])
        at = text_from = m.end()
        if html.startswith("<!--", p) and not m[0].endswith("-->"):
            text_from = n
            break
        if end := m[1]:
            end, up = end.lower(), node
            while up.parent and up.name != end:
                up = up.parent
            if up.parent:
                # An inline end does not close blocks that opened inside it.
                if end in BLOCK or not _block_between(node, up):
                    node = up.parent
            elif end == "br":
                node.items.append("\n")
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if name in ENDS_P:
            up = node
            while up.parent and up.name not in HOLDERS and up.name != "p":
                up = up.parent
            if up.name == "p":
                node = up.parent
        if name in ENDS:
            up, found = node, None
            while up.parent and up.name not in HOLDERS or up.name in ENDS[name]:
                if up.name in ENDS[name]:
                    found = up
                up = up.parent
            if found:
                node = found.parent
        text = m[3]
        own = Node(name, _names(text) if text and not text.isspace() else "", node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(html, at)
            own.items.append(html[at : close.start()])
            at = text_from = max(close.end(), at)
        elif name not in VOID and not text.endswith("/"):
            node = own
        elif name not in VOID and name in BLOCK:
            node = own  # a slash means nothing on an HTML element
    if text_from < n:
        node.items.append(html[text_from:])
    return root


def wrap(root: Node) -> Node:
    """Gives runs of text and inline elements that stand beside blocks, directly in the page, html, body or an inline element with
    blocks in it, an element of their own, so that they are weighed as blocks are."""
    holds: dict[int, bool] = {}
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.children)
    for x in reversed(order):
        holds[id(x)] = x.name in BLOCK or any(holds[id(c)] for c in x.children)
    stack = [root]
    while stack:
        x = stack.pop()
        items, run = [], None
        for item in x.items:
            if not isinstance(item, str) and holds[id(item)]:
                items.append(item)
                run = None
                if item.name in ("html", "body") or item.name not in BLOCK and item.name not in HIDDEN:
                    stack.append(item)
            elif run is None and (not item.strip() if isinstance(item, str) else item.name in HIDDEN):
                items.append(item)
            else:
                if run is None:
                    run = Node(RUN, "", None)
                    run.parent, run.depth = x, x.depth + 1
                    items.append(run)
                run.items.append(item)
                if not isinstance(item, str):
                    item.parent = run
                    run.children.append(item)
        x.items, x.children = items, [i for i in items if not isinstance(i, str)]
    return root


def _block_between(node: Node, up: Node) -> bool:
    while node is not up:
        if node.name in BLOCK:
            return True
        node = node.parent
    return False


def _names(text: str) -> str:
    """Words of class, id, role and label values, and whether the element is hidden."""
    out = []
    for k, v in _ATTR.findall(text):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id", "role", "aria-label", "itemprop", "data-role", "data-component"):
            out.append(v)
        elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            out.append("hidden")
    return " ".join(out)


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 14)
def _attr_counts(attrs: str) -> tuple[int, int]:
    words = set(_WORDS.findall(_CAMEL.sub(" ", attrs).lower()))
    return len(words & AWAY), len(words & TOWARDS)


@lru_cache(1 << 14)
def _in_line(attrs: str) -> bool:
    return not AWAY_IN_LINE.isdisjoint(_WORDS.findall(_CAMEL.sub(" ", attrs).lower()))


def _measure(node: Node) -> None:
    """Sums over the subtree of each node, without recursion."""
    stack, order = [node], []
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.children)
    for x in reversed(order):
        own = " ".join(s for s in x.items if isinstance(s, str)) if x.name not in HIDDEN else ""
        own = own.strip()
        x.n_text, x.n_words = len(own), own.count(" ") + bool(own)
        x.n_punct = sum(own.count(c) for c in ".,;:!?") if own else 0
        x.n_link, x.n_blocks, x.links = (x.n_text if x.name == "a" else 0), 0, int(x.name == "a")
        for c in x.children:
            x.n_text += c.n_text
            x.n_words += c.n_words
            x.n_punct += c.n_punct
            x.n_link += c.n_text if x.name == "a" else c.n_link
            x.n_blocks += c.n_blocks + (c.name in BLOCK)
            x.links += c.links


def candidates(root: Node) -> list[Node]:
    """Block elements, runs and inline elements whose names tell that they don't belong, parents first; what is under a hidden
    element or a head is no candidate."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.name in BLOCK and x.name not in ("html", "body") or x.name == RUN or x.attrs and x.name not in BLOCK and _in_line(x.attrs):
            out.append(x)
        stack.extend(c for c in reversed(x.children) if c.name not in HIDDEN)
    return out


N_FEATURES = 26


def features(nodes: list[Node], root: Node) -> np.ndarray:
    """One row a node: name, subtree density, attribute words of it and its ancestors, depth, and how it stands among its siblings."""
    total = max(root.n_text, 1)
    rows = []
    above: dict[int, tuple[int, int, int, int]] = {}
    places: dict[int, dict[int, int]] = {}
    for i, x in enumerate(nodes):
        away, towards = _attr_counts(x.attrs) if x.attrs else (0, 0)
        section = "heading" if len(x.name) == 2 and x.name[0] == "h" and x.name[1].isdigit() else x.name if x.name in _SECTIONS else "other" if x.name in BLOCK else "run" if x.name == RUN else "inline"
        boiler = section in ("nav", "footer", "aside", "form") or section == "header" and not _inside(x, "article")
        up = x.parent
        while up is not None and id(up) not in above and up.parent is not None:
            up = up.parent
        a, t, b, m = above.get(id(up), (0, 0, 0, 0)) if up is not None else (0, 0, 0, 0)
        above[id(x)] = (a + away, t + towards, b + boiler, m + (section in ("article", "main")))
        brothers = x.parent.children
        if id(x.parent) not in places:
            places[id(x.parent)] = {id(c): k for k, c in enumerate(brothers)}
        place = places[id(x.parent)][id(x)]
        before = brothers[place - 1] if place else None
        after = brothers[place + 1] if place + 1 < len(brothers) else None
        n = x.n_text
        rows.append((
            _SECTIONS.index(section), x.depth, math.log1p(n), n / total, x.n_link / n if n else 0.0, x.links, x.n_punct / x.n_words if x.n_words else 0.0,
            n / (x.n_blocks + 1), x.n_words / max(x.links, 1), away, towards, a, t, b, m, boiler, len(brothers), place / max(len(brothers), 1),
            math.log1p(before.n_text) if before else -1.0, math.log1p(after.n_text) if after else -1.0, x.n_blocks, i / len(nodes),
            n / max(x.parent.n_text, 1), x.parent.n_link / max(x.parent.n_text, 1), sum(c.name == "li" for c in x.children), float(before.n_link / max(before.n_text, 1)) if before else -1.0,
        ))
    return np.array(rows, np.float32).reshape(len(rows), N_FEATURES)


def _inside(x: Node, name: str) -> bool:
    while x := x.parent:
        if x.name == name:
            return True
    return False


class Trees:
    """Gradient-boosted regression trees of the logistic loss, as arrays: a full tree of one depth each."""

    def __init__(self, n_trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = n_trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        n_nodes, width = (1 << self.depth) - 1, self.bins + 1
        self.feature, self.cut, self.leaf = np.zeros((self.n_trees, n_nodes), np.int64), np.full((self.n_trees, n_nodes), np.inf, np.float32), np.zeros((self.n_trees, 1 << self.depth))
        score = np.full(len(y), self.base)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                n, first = 1 << d, (1 << d) - 1
                best = np.full(n, 1e-6)
                for f in range(x.shape[1]):
                    slot = at * width + binned[:, f]
                    gs, hs = (np.cumsum(np.bincount(slot, v, n * width).reshape(n, width), axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    gain[:, len(edges[f]) :] = 0
                    k = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(n), k] > best):
                        best[i] = gain[i, k[i]]
                        self.feature[t, first + i], self.cut[t, first + i] = f, edges[f][k[i]]
                at = 2 * at + (x[np.arange(len(y)), self.feature[t, first + at]] > self.cut[t, first + at])
            gs, hs = (np.bincount(at, v, 1 << self.depth) for v in (g, h))
            self.leaf[t] = self.rate * gs / (hs + self.ridge)
            score += self.leaf[t][at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                node = (1 << d) - 1 + at
                at = 2 * at + (x[rows, feature[node]] > cut[node])
            out += leaf[at]
        return out


def decode(nodes: list[Node], log_odds: np.ndarray) -> set[int]:
    """Ids of the nodes to keep: the labelling of most probability in which nothing under a dropped node is kept.

    Keeping a node and choosing freely below is weighed against dropping it with all that is under it.
    """
    keep_gain = dict(zip(map(id, nodes), log_odds.tolist(), strict=True))
    own = set(keep_gain)
    total: dict[int, float] = {}
    parent: dict[int, int] = {}
    for x in nodes:
        up = x.parent
        while up is not None and id(up) not in own:
            up = up.parent
        parent[id(x)] = id(up) if up is not None else 0
    for x in reversed(nodes):  # children come after their parents
        # Gain over dropping the whole subtree.
        gain = keep_gain[id(x)] + total.get(id(x), 0.0)
        keep_gain[id(x)] = gain
        if gain > 0:
            total[parent[id(x)]] = total.get(parent[id(x)], 0.0) + gain
    kept: set[int] = set()
    for x in nodes:
        if keep_gain[id(x)] > 0 and (not parent[id(x)] or parent[id(x)] in kept):
            kept.add(id(x))
    return kept


def blocks(root: Node, nodes: list[Node], kept: set[int]) -> list[str]:
    """Texts of the kept blocks in page order. A block's text ends where another block begins or ends."""
    own, out, piece = {id(x) for x in nodes}, [], []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(piece))).strip()
        piece.clear()
        if text:
            out.append(text)

    # Open elements with the place in their items, and whether text in them is kept.
    stack: list[tuple[Node, Iterator, bool]] = [(root, iter(root.items), False)]
    while stack:
        node, items, live = stack[-1]
        for item in items:
            if isinstance(item, str):
                if live:
                    piece.append(item)
                continue
            if item.name in HIDDEN:
                continue
            if item.name in ("br", "hr") and live:
                piece.append(" ")
            inside = id(item) in kept if id(item) in own else live
            if item.name in BLOCK or item.name == RUN:
                flush()
            elif live and not inside:
                piece.append(" ")
            stack.append((item, iter(item.items), inside))
            break
        else:
            stack.pop()
            if node.name in BLOCK or node.name == RUN or not stack:
                flush()
    return out


# ---- training pages: made from a rule, so that every node's label is known ----


def _sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouéäö") for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ","])


def _prose(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_sentence(rng, rng.randrange(3, 16)) for _ in range(rng.randrange(low, high)))


#: Stands in runs of made pages that are to be kept; of no weight in any feature but the length.
MARK = "\u2063"


def training_page(rng: random.Random) -> str:
    """A page whose article's blocks have the attribute data-keep, and whose article's runs hold the mark MARK."""
    if rng.random() < 0.04:
        return MARK + rng.choice(["", "\n"]) + _prose(rng, 1, rng.choice([2, 4, 20]))  # no markup at all
    links = lambda low, high: "".join(f'<li><a href="/{rng.randrange(99)}">{_sentence(rng, rng.randrange(1, 4))}</a></li>' for _ in range(rng.randrange(low, high)))
    keep = " data-keep"
    inner = []
    if rng.random() < 0.7:
        inner.append(f"<h1{keep}>{_sentence(rng, rng.randrange(3, 10))}</h1>")
    for _ in range(rng.choice([1, 1, 2, 4, 8, 15])):
        kind = rng.random()
        if kind < 0.72:
            line = f'<span class="{rng.choice(["ad", "advert", "promo", "sponsored-link", "share-tools"])}">{_sentence(rng, rng.randrange(1, 5))}</span> {_prose(rng, 1, 2)}' if rng.random() < 0.06 else ""
            inner.append(f"<p{keep}>{rng.choice(['', '<b>'])}{_prose(rng, 1, rng.choice([2, 3, 9]))} {line}{rng.choice(['', '<br>', '</p>'])}")
        elif kind < 0.78:
            inner.append(f"<h2{keep}>{_sentence(rng, rng.randrange(1, 7))}</h2>")
        elif kind < 0.83:
            inner.append(f"<ul{keep}>" + "".join(f"<li{keep}>{_sentence(rng, rng.randrange(2, 14))}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
        elif kind < 0.87:
            inner.append(f"<blockquote{keep}><p{keep}>{_prose(rng, 1, 3)}</p></blockquote>")
        elif kind < 0.9:
            inner.append(f"<pre{keep}>{_prose(rng, 1, 3)}</pre>")
        elif kind < 0.93:
            inner.append(f"<table{keep}><tr{keep}>" + "".join(f"<td{keep}>{_sentence(rng, 2)}</td>" for _ in range(3)) + "</tr></table>")
        elif kind < 0.97:
            inner.append(f'<div class="{rng.choice(["ad", "advert", "promo", "related", "share social", "newsletter-signup", "ad-slot"])}">{_prose(rng, 1, 3)}</div>')
        else:
            inner.append(f'<aside class="{rng.choice(["", "related", "pullquote sidebar"])}"><p>{_prose(rng, 1, 3)}</p></aside>')
    body = "".join(inner)
    tag = rng.choice(["article", "article", "article", "main", "div", "section"])
    name = rng.choice(["", ' class="post"', ' class="entry-content"', ' id="content"', ' class="article-body"', ' id="main"']) if tag in ("article", "main") or rng.random() < 0.1 else rng.choice([' class="post"', ' class="entry-content"', ' id="content"', ' class="article-body"', ' id="main-content"', ' class="story"'])
    article = f"<{tag}{name}{keep}>{body}</{tag}>"
    bare = rng.random() < 0.2
    if bare:
        # The article lies directly in the body, in runs between headings, rules and breaks, some of it in inline elements.
        pieces = []
        for k in range(rng.choice([1, 1, 2, 4])):
            if k or rng.random() < 0.5:
                pieces.append(rng.choice([f"<h2{keep}>{_sentence(rng, 4)}</h2>", "<hr>", f"<p{keep}>{_prose(rng, 1, 3)}</p>"]))
            text = rng.choice([" ", "<br><br>", "<br>"]).join(rng.choice(["{}", "{}", "<span>{}</span>", "<b>{}</b>", "<font>{}</font>"]).format(_prose(rng, 1, 4)) for _ in range(rng.randrange(1, 5)))
            pieces.append(MARK + text)
        article = "".join(pieces)
        if rng.random() < 0.4:  # or in paragraphs without anything around them
            article = "".join(x for x in inner if keep in x)
    elif rng.random() < 0.25:
        article = f"<main{keep}>{article}</main>"
    if not bare and rng.random() < 0.2:
        article = f'<div class="{rng.choice(["wrapper", "container", "page", "row"])}"{keep}>{article}</div>'
    nav = rng.choice([f"<nav><ul>{links(2, 9)}</ul></nav>", f'<div class="{rng.choice(["menu", "navbar", "nav-links", "breadcrumb"])}"><ul>{links(2, 9)}</ul></div>', f'<ul class="menu">{links(3, 9)}</ul>', ""])
    header = rng.choice(["", "", f"<header><p>{_sentence(rng, 3)}</p>{nav}</header>", f'<div id="header"><h2>{_sentence(rng, 3)}</h2></div>', f'<div class="site-header masthead">{_sentence(rng, 4)}</div>', f"<header><h1>{_sentence(rng, 3)}</h1></header>"])
    away = []
    if rng.random() < 0.25:  # runs that are not the article
        away.append(rng.choice([" | ".join(f'<a href="/{k}">{_sentence(rng, 1)}</a>' for k in range(rng.randrange(2, 7))), f'<a href="#main">{_sentence(rng, 3)}</a>', f'<span class="{rng.choice(["ad", "breadcrumb", "share", "cookie-notice"])}">{_prose(rng, 1, 2)}</span>']) + "<hr>")
    for _ in range(rng.randrange(0, 3)):
        away.append(rng.choice([
            f'<div class="{rng.choice(["ad", "ads", "advert", "banner", "sponsored", "ad-container"])}">{_prose(rng, 1, 3)}</div>',
            f'<div class="{rng.choice(["cookie-notice", "cookie-banner", "consent", "gdpr", "notice"])}"><p>{_prose(rng, 1, 3)}</p></div>',
            f'<aside>{rng.choice(["", "<h3>" + _sentence(rng, 2) + "</h3>"])}<p>{_prose(rng, 1, 4)}</p><ul>{links(1, 5)}</ul></aside>',
            f'<div class="sidebar"><h3>{_sentence(rng, 2)}</h3><p>{_prose(rng, 1, 4)}</p></div>',
            f"<form><p>{_sentence(rng, 5)}</p><label>{_sentence(rng, 2)}</label><input></form>",
            f'<div class="newsletter"><p>{_prose(rng, 1, 2)}</p></div>',
            f'<div class="related"><h3>{_sentence(rng, 2)}</h3><ul>{links(2, 6)}</ul></div>',
        ]))
    comments = rng.choice(["", "", "", f'<{(c := rng.choice(["section", "div"]))} {rng.choice(["id", "class"])}="{rng.choice(["comments", "comment-list", "reader-comments", "disqus_thread", "responses comments"])}"><h3>{_sentence(rng, 2)}</h3>' + "".join(f'<div class="comment"><p>{_prose(rng, 1, 5)}</p></div>' for _ in range(rng.randrange(1, 5))) + f"</{c}>", f'<ol class="commentlist">' + "".join(f"<li><p>{_prose(rng, 1, 4)}</p></li>" for _ in range(rng.randrange(1, 5))) + "</ol>"])
    footer = rng.choice([f"<footer>&copy; {_prose(rng, 1, 3)}</footer>", f"<footer><p>{_prose(rng, 1, 3)}</p><ul>{links(1, 6)}</ul></footer>", f'<div id="footer"><p>{_prose(rng, 1, 3)}</p></div>', f'<div class="site-footer copyright">{_sentence(rng, 7)}</div>', "", f"<hr>&copy; {rng.randrange(1990, 2030)} {_sentence(rng, 2)}"])
    if not bare and rng.random() < 0.3:
        article = article[: -len("</div>")] + comments + "</div>" if article.endswith("</div>") else article + comments
        comments = ""
    cut = rng.randrange(len(away) + 1)
    page = [header, nav if "<nav" not in header and "menu" not in header else "", *away[:cut], article, comments, *away[cut:], footer]
    return f'<html><head><title>{_sentence(rng, 4)}</title><style>p{{}}</style></head><body>{"".join(page)}</body></html>'


def labelled(page: str) -> tuple[Node, list[Node], np.ndarray]:
    """The tree of a made page, its candidates, and which of them are to be kept."""
    keeps = ["data-keep" in (m[3] or "") for m in _TAG.finditer(page) if m[2]]
    root = parse(page)
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if x is not root:
            order.append(x)
        stack.extend(reversed(x.children))
    label = {id(x): k for x, k in zip(order, keeps, strict=True)}
    _measure(wrap(root))
    nodes = candidates(root)
    marked = lambda x: any(isinstance(i, str) and MARK in i for i in x.items)
    return root, nodes, np.array([marked(x) if x.name == RUN else label[id(x)] for x in nodes], bool)


@cache
def trained(pages: int = 900, seed: int = 11) -> Trees:
    """The model, from made pages: a bounded training set that no page of the corpus is part of."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        root, nodes, keep = labelled(training_page(rng))
        xs.append(features(nodes, root))
        ys.append(keep.astype(float))
    return Trees().fit(np.concatenate(xs), np.concatenate(ys))


def texts_of(pages: list[str | None], model: Trees) -> list[str]:
    """The main text of each page."""
    trees, rows = [], []
    for html in pages:
        root = wrap(parse(html or ""))
        _measure(root)
        nodes = candidates(root)
        trees.append((root, nodes))
        rows.append(features(nodes, root))
    odds = model.log_odds(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for root, nodes in trees:
        out.append("\n".join(blocks(root, nodes, decode(nodes, odds[at : at + len(nodes)]))))
        at += len(nodes)
    return out


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", chunk: int = 64) -> DataFrame:
    """The columns in keep and text string: the page's article, its blocks joined by newlines, in one pass without a shuffle.

    Trees score every block element, every run of text beside blocks directly in the body, and inline elements named as adverts and
    the like; the decoding keeps nothing under an element that it drops. Character references are
    decoded, white space inside a block becomes one space. A null or empty page, and one without an article, gives an
    empty text. Broken markup is read as browsers do, roughly: a new block ends an open paragraph, stray ends are passed
    over. Repeated rows keep their rows; other columns play no part.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    modest_batches(pages.sparkSession)
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            html = x.column(len(keep))
            out: list[str] = []
            for s in range(0, len(html), chunk):
                out += texts_of(html.slice(s, chunk).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(len(keep))), pa.array(out, pa.string())], [f.name for f in schema])

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)
