"""Main-text extraction by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements and text blocks. Every node is content
or not. Node potentials are linear in features of the node (its tag's kind, words
of its class, id and role, the length and link share of its text); edge potentials
say how a node's label goes with its parent's; an element is content if something
below it is, so an only child's label is its parent's. Messages are summed upward and then
downward, which gives each node's exact marginal; text blocks over one half are
the page's text.

The potentials are trained by maximum likelihood (the gradient needs the same
marginals) on labelled pages that ``labelled_pages`` writes from templates, as the
tables have no labelled ones. Pages of a chunk are one forest, so that messages
of one depth move together.

Defined cases: null and empty html give an empty text; unclosed, misnested and
unknown tags, comments and cut-off markup never fail, at any depth; repeated rows get
the same result, and an empty table gives no rows. A page of any length is read whole:
its nodes are kept as arrays, about 100 bytes each, and a tag costs the same however
deep the page is there. Scripts, styles, templates and the head never hold text. A text
block of exactly one half is left out. Other columns are ignored, whatever their names;
of the columns to keep none may be named text or n_chars.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary, chunks

#: Nodes of one forest, and pages, at most (or one larger page).
FOREST_NODES, FOREST_PAGES = 200_000, 200
#: Levels of so few nodes are worked on node by node.
NARROW = 3
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Tags of HTML by what they do here.
RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "textarea", "title", "select", "head"}
#: Of these, what has no end tag goes on to the page's end; any other of RAW is then only a tag.
TO_THE_END = {"script", "style", "textarea", "title"}
MARK_OF_RAW = re.compile(rf"<(?:!--|/?(?:{'|'.join(sorted(RAW - {'head'}))})(?=[\s/>]|\Z))", re.A | re.I)
END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.A | re.I) for name in TO_THE_END} | {"head": re.compile(r"(?:</head|<body)(?=[\s/>]|\Z)", re.A | re.I)}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
KINDS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "body": "body", "html": "html", "p": "p", "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "nav": "nav", "menu": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form", "fieldset": "form", "button": "form", "dialog": "dialog",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure",
    "address": "address", "details": "details", "summary": "details", "hgroup": "section", "center": "div", "search": "form",
}
#: What a start tag closes if it is open in the same list, table or paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
GOOD_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text", "prose"}
BAD_WORDS = {
    "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "widget", "footer", "header", "masthead", "copyright",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "reply", "replies", "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "more", "newsletter",
    "subscribe", "signup", "login", "form", "search", "pagination", "pager", "tags", "toolbar", "legal", "complementary", "contentinfo",
}
FEATURES = [*dict.fromkeys(KINDS.values()), "good_word", "bad_word", "leaf", "leaf_words", "leaf_links", "leaf_short", "leaf_stop", "leaf_in_p", "leaf_in_heading", "leaf_in_item", "leaf_other", "bias"]
COLUMN = {name: i for i, name in enumerate(FEATURES)}
NEUTRAL = [COLUMN["div"], COLUMN["section"], COLUMN["bias"]]
#: Edges by the child: an element, an element with a bad word or of a boilerplate kind, a text block, a header in an article.
EDGES = 4
#: An only child is content if and only if its parent is: potentials that are not trained.
ONLY, EQUAL = EDGES, np.array([[0.0, -40.0], [-40.0, 0.0]])
APART = {"nav", "aside", "footer", "form", "header", "dialog"}


def raw_ends(html: str) -> dict[int, int]:
    """Where the end tag of each element of RAW is, by where its start tag ends; one without an end tag is not there.

    An end tag belongs to the last open start tag of its name. Comments and what is in
    scripts and the like hold no tags; a start tag of svg or math may close itself.
    """
    ends, opened, at = {}, {}, 0
    while mark := MARK_OF_RAW.search(html, at):
        match = TOKEN.match(html, mark.start())
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        if match[1] or match[4]:
            if opened.get(name):
                ends[opened[name].pop()] = match.start()
        elif name in TO_THE_END:
            end = END_OF[name].search(html, at)
            ends[at] = at = end.start() if end else len(html)
        elif name not in ("svg", "math") or not (match[3] or match[6] or "").endswith("/"):
            opened.setdefault(name, []).append(at)
    return ends


class _Open:
    """The elements that are open: (name, node, kind), with where each name was opened last."""

    def __init__(self, root: int):
        self.stack = [("html", root, "html")]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.bounds: list[int] = []  # lists and tables
        self.articles = 0

    def push(self, name: str, node: int, kind: str) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if kind in ("list", "table") and name != "tr":
            self.bounds.append(len(self.stack))
        self.articles += kind in ("article", "main")
        self.stack.append((name, node, kind))

    def close(self, place: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.stack) > place:
            name, _, kind = self.stack.pop()
            self.at[name].pop()
            if kind in ("list", "table") and name != "tr":
                self.bounds.pop()
            self.articles -= kind in ("article", "main")

    def last(self, *names: str) -> int:
        """Where one of these was opened last; 0 if none is open (but for the root)."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


class Page:
    """Nodes of one page: parent (-1: none), depth and edge kind; features as (row, column, value); text of text blocks."""

    __slots__ = ("parent", "depth", "edge", "rows", "columns", "values", "texts")

    def __init__(self, html: str):
        self.parent, self.depth, self.edge = array("i"), array("i"), array("b")
        self.rows, self.columns, self.values = array("i"), array("b"), array("f")
        self.texts: dict[int, str] = {}
        self._read(html)
        parents = np.frombuffer(self.parent, np.int32)[1:]
        only = np.append(False, np.bincount(parents, minlength=1)[parents] == 1)
        np.frombuffer(self.edge, np.int8)[only] = ONLY
        # An only child of a kind that says nothing adds no evidence, so that it does not matter how many wrap each other.
        rows, columns = np.frombuffer(self.rows, np.int32), np.frombuffer(self.columns, np.int8)
        plain = only & (np.bincount(rows, ~np.isin(columns, NEUTRAL), len(only)) == 0)
        np.frombuffer(self.values, np.float32)[plain[rows]] = 0.0

    def _node(self, parent: int, features: dict[str, float], edge: int) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.edge.append(edge)
        for name, value in (*features.items(), ("bias", 1.0)):
            self.rows.append(node)
            self.columns.append(COLUMN[name])
            self.values.append(value)
        return node

    def _read(self, html: str) -> None:
        opened = _Open(self._node(-1, {"html": 1.0}, 0))
        stack = opened.stack
        pending: list[str] = []
        linked = [0, 0]  # depth of open links, characters in links
        ends = None

        def flush() -> None:
            if pending:
                text = " ".join(unescape("".join(pending)).split())
                if text:
                    kind = stack[-1][2]
                    words = text.count(" ") + 1
                    links = min(1.0, linked[1] / max(1, sum(map(len, pending))))
                    found = {"leaf": 1.0, "leaf_words": min(4.0, math.log1p(words)), "leaf_links": links, "leaf_short": float(words < 4), "leaf_stop": float(text[-1] in ".!?;:\"'")}
                    found["leaf_in_p" if kind in ("p", "quote") else "leaf_in_heading" if kind in ("h1", "heading") else "leaf_in_item" if kind == "item" else "leaf_other"] = 1.0
                    self.texts[self._node(stack[-1][1], found, 2)] = text
                pending.clear()
            linked[0] = linked[1] = 0

        def add(text: str) -> None:
            pending.append(text)
            if linked[0]:
                linked[1] += len(text)

        at = 0
        while True:
            match = TOKEN.search(html, at)
            if match is None:
                add(html[at:])
                break
            if match.start() > at:
                add(html[at : match.start()])
            at = match.end()
            name = match[2] or match[5]
            if not name:
                continue
            name, closing = name.lower(), bool(match[1] or match[4])
            if not closing and name in RAW:
                if name == "head":
                    # The head ends where it says so, or where the body starts.
                    end = END_OF[name].search(html, at)
                    at = end.start() if end else at
                elif name in TO_THE_END:
                    end = END_OF[name].search(html, at)
                    at = end.start() if end else len(html)
                else:
                    ends = raw_ends(html) if ends is None else ends
                    at = ends.get(at, at)
                continue
            if name == "a":
                linked[0] = 0 if closing else 1
                continue
            if name in ("br", "hr"):
                add(" ")
                continue
            kind = KINDS.get(name)
            if kind is None or name in VOID:
                continue
            flush()
            if name in ("html", "body") and (closing or opened.at.get(name)):
                continue
            if closing:
                place = opened.last(name)
                if place:
                    opened.close(place)
                continue
            if stack[-1][0] == "p":
                opened.close(len(stack) - 1)
            closes = CLOSES.get(name)
            if closes:
                place = opened.last(*closes)
                if place > (opened.bounds[-1] if opened.bounds else 0):
                    opened.close(place)
            if kind in ("h1", "heading") and stack[-1][2] in ("h1", "heading"):
                opened.close(len(stack) - 1)
            features = {kind: 1.0}
            attributes = match[3] or match[6]
            bad = kind in APART
            if attributes:
                for m in NAMED.finditer(attributes):
                    for word in WORD.findall(m[2] or m[3] or m[4] or ""):
                        word = word.lower()
                        if word in BAD_WORDS:
                            features["bad_word"], bad = 1.0, True
                        elif word in GOOD_WORDS:
                            features["good_word"] = 1.0
            edge = 3 if kind == "header" and opened.articles else 1 if bad else 0
            opened.push(name, self._node(stack[-1][1], features, edge), kind)
        flush()


def _soft_one(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Forest:
    """Nodes of many pages as arrays, in levels of one depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        join = lambda name, kind: np.concatenate([np.frombuffer(getattr(p, name), kind) for p in pages] or [np.zeros(0, kind)])
        self.parent = join("parent", np.int32).astype(np.int64)
        self.parent += np.where(self.parent >= 0, np.repeat(starts[:-1], sizes), 0)
        self.edge = join("edge", np.int8)
        self.rows = join("rows", np.int32) + np.repeat(starts[:-1], [len(p.rows) for p in pages])
        self.columns, self.values = join("columns", np.int8), join("values", np.float32)
        depth = join("depth", np.int32)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1]) if len(order) else []

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """Log odds of content of each node by its own features."""
        return np.bincount(self.rows, weights[self.columns] * self.values, len(self.parent))

    def gradient(self, error: np.ndarray) -> np.ndarray:
        """The features' sums, weighed by ``error`` of each node."""
        return np.bincount(self.columns, self.values * error[self.rows], len(FEATURES))

    def marginals(self, weights: np.ndarray, edges: np.ndarray, want_edges: bool = False):
        """P(content) by node; with want_edges also the joint of (parent, child) labels by node.

        All messages are log odds; edges: kind, parent's label, child's label.
        """
        edges = np.concatenate([edges, EQUAL[None]])
        odds = self.unary(weights)
        up, down = np.zeros_like(odds), np.zeros_like(odds)
        table, parent = edges.tolist(), self.parent
        for level in self.levels[:0:-1]:
            if len(level) <= NARROW:
                for i in level.tolist():
                    (e00, e01), (e10, e11) = table[self.edge[i]]
                    x = float(odds[i])
                    message = _soft_one(e10, e11 + x) - _soft_one(e00, e01 + x)
                    up[i] = message
                    odds[parent[i]] += message
                continue
            e, x = edges[self.edge[level]], odds[level]
            up[level] = np.logaddexp(e[:, 1, 0], e[:, 1, 1] + x) - np.logaddexp(e[:, 0, 0], e[:, 0, 1] + x)
            np.add.at(odds, parent[level], up[level])
        joint = np.zeros((len(odds), 2, 2)) if want_edges else None
        for level in self.levels[1:]:
            if len(level) <= NARROW and not want_edges:
                for i in level.tolist():
                    (e00, e01), (e10, e11) = table[self.edge[i]]
                    x = float(odds[parent[i]] + down[parent[i]] - up[i])
                    down[i] = _soft_one(e01, e11 + x) - _soft_one(e00, e10 + x)
                continue
            e, x = edges[self.edge[level]], odds[parent[level]] + down[parent[level]] - up[level]
            down[level] = np.logaddexp(e[:, 0, 1], e[:, 1, 1] + x) - np.logaddexp(e[:, 0, 0], e[:, 1, 0] + x)
            if want_edges:
                both = e.copy()
                both[:, 1] += x[:, None]
                both[:, :, 1] += odds[level][:, None]
                both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
                joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        p = 1 / (1 + np.exp(np.clip(-odds - down, -60, 60)))
        return (p, joint) if want_edges else p


MARK = "\ue000"
_WORDS = "ba co di fu ga he ki lo mu na po ri su te vo wa xi yo za ele mar ton ver sal per int con tra ment ing".split()


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages from templates; text blocks of the main text start with MARK."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(_WORDS) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 2, high: int = 30) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(low, high))) + "</ul>"

    def named(tag: str, names: list[str], inner: str) -> str:
        how = rng.choice(["class", "class", "id"])
        return f'<{tag} {how}="{rng.choice(names)}">{inner}</{tag}>'

    def boiler() -> str:
        text = lambda: "".join(f"<p>{sentence(3, 25)}</p>" for _ in range(rng.randint(1, 4)))
        return rng.choice([
            lambda: f"<nav>{links(3, 8)}</nav>",
            lambda: named("div", ["menu", "nav-bar", "site-navigation", "breadcrumbs"], links(2, 7)),
            lambda: f"<header>{words(1, 3)} {links(0, 4)}</header>",
            lambda: f"<header><h1>{words(1, 4)}</h1><p>{sentence(2, 8)}</p></header>",
            lambda: f"<footer>&copy; {words(1, 3)} &middot; {sentence(3, 20)}</footer>",
            lambda: f"<footer><p>{sentence(3, 20)}</p>{links(0, 5)}</footer>",
            lambda: f"<aside><h3>{words(1, 3)}</h3>{rng.choice([links(2, 6), text()])}</aside>",
            lambda: named("div", ["sidebar", "widget", "side-bar widget"], rng.choice([links(2, 6), text()])),
            lambda: named("div", ["ad", "ads", "advert", "ad-banner", "sponsored", "promo-box"], rng.choice([sentence(3, 25), text()])),
            lambda: named("div", ["cookie-notice", "consent-banner", "notice", "alert"], sentence(6, 30) + rng.choice(["", "<button>OK</button>"])),
            lambda: f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>",
            lambda: named("section", ["comments", "comment-list", "replies"], f"<h2>{words(1, 2)}</h2>" + text()),
            lambda: named("div", ["comments", "disqus_thread", "discussion"], "".join(named("div", ["comment", "reply"], f"<p>{sentence(5, 30)}</p>") for _ in range(rng.randint(1, 5)))),
            lambda: named("div", ["share-buttons", "social", "related-posts", "newsletter", "subscribe"], rng.choice([links(2, 5), sentence(3, 15)])),
        ])()

    def content() -> str:
        blocks = [rng.choice([f"<h1>{MARK}{words(2, 8)}</h1>", f"<h2>{MARK}{words(2, 8)}</h2>", ""])]
        for _ in range(rng.choice([1, 1, 2, 4, 8, 12])):
            blocks.append(rng.choices([
                f"<p>{MARK}{sentence()} {sentence()}</p>", f"<p>{MARK}{sentence(1, 4)}</p>", f"<p><b>{MARK}{sentence(3, 12)}<br>", f"<h3>{MARK}{words(1, 5)}</h3>",
                "<ul>" + "".join(f"<li>{MARK}{sentence(2, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>",
                f"<blockquote>{MARK}{sentence()}</blockquote>", f'<p>{MARK}{sentence(4, 12)} <a href="/x">{words(1, 3)}</a> {sentence(3, 9)}</p>',
                "<table><tr>" + "".join(f"<td>{MARK}{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>", f"<pre>{MARK}{words(4, 12)}</pre>",
                f"<div>{MARK}{sentence()}</div>", named("div", ["ad", "share-bar", "promo", "related"], sentence(3, 15)), f"<aside>{sentence(3, 12)}</aside>",
            ], [10, 4, 2, 1, 1, 1, 2, 1, 1, 2, 1, 1])[0])
        return "".join(blocks)

    pages = []
    for _ in range(n):
        inner = content()
        wrap = rng.choice(["article", "article", "main", "div", "div", "section", "plain", "both"])
        if wrap in ("article", "main", "both") and rng.random() < 0.25:
            inner = f"<header><h1>{MARK}{words(2, 7)}</h1></header>" + inner
        if wrap in ("article", "both") and rng.random() < 0.2:
            inner += f"<footer>{rng.choice([sentence(2, 8), links(1, 3)])}</footer>"
        if wrap in ("article", "main"):
            inner = f"<{wrap}>{inner}</{wrap}>"
        elif wrap in ("div", "section"):
            inner = named(wrap, ["content", "post-body", "entry-content", "main-text", "story", "x1"], inner)
        elif wrap == "both":
            inner = f'<main><div class="page"><article>{inner}</article>{boiler() if rng.random() < 0.5 else ""}</div></main>'
        wraps = lambda x, most: (lambda n: "<div>" * n + x + "</div>" * n)(rng.choice([0, 0, 1, 2, rng.randint(0, most)]))
        alone = rng.random() < 0.25
        before = "".join(wraps(boiler(), 6) for _ in range(0 if alone else rng.randint(0, 3)))
        after = "".join(wraps(boiler(), 6) for _ in range(0 if alone else rng.randint(0, 3)))
        body = before + ("" if rng.random() < 0.04 else wraps(inner, 30)) + after
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(["page", "wrap", "container", "site"])}">{body}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>")
    return pages


def labels_of(page: Page) -> np.ndarray:
    """1 for text blocks that start with MARK (which is then removed) and all elements above them."""
    y = np.zeros(len(page.parent))
    for node, text in page.texts.items():
        if text.startswith(MARK):
            page.texts[node] = text.lstrip(MARK)
            while node >= 0 and not y[node]:
                y[node] = 1
                node = page.parent[node]
    return y


@lru_cache(maxsize=1)
def train(n_pages: int = 800, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and edge potentials by gradient ascent on the likelihood of labelled pages."""
    pages = [Page(h) for h in labelled_pages(n_pages, seed)]
    y = np.concatenate([labels_of(p) for p in pages])
    forest = Forest(pages)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((EDGES + 1, 2, 2))
    np.add.at(seen, (forest.edge[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    weights, edges = np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2))
    state = [np.zeros(weights.size + edges.size), np.zeros(weights.size + edges.size)]
    for step in range(1, rounds + 1):
        p, joint = forest.marginals(weights, edges, want_edges=True)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.edge[child], joint[child])
        gradient = np.concatenate([forest.gradient(y - p) - 2 * weights, ((seen - expected)[:EDGES] - 2 * edges).ravel()])
        state = [0.9 * state[0] + 0.1 * gradient, 0.99 * state[1] + 0.01 * gradient**2]
        move = 0.15 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights = weights + move[: weights.size]
        edges = edges + move[weights.size :].reshape(edges.shape)
    return weights, edges


def main_texts(htmls: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    out: list[str] = []
    pages: list[Page] = []

    def close() -> None:
        p = Forest(pages).marginals(*model)
        offset = 0
        for page in pages:
            out.append("\n".join(text for node, text in page.texts.items() if p[offset + node] > 0.5))
            offset += len(page.parent)
        pages.clear()

    nodes = 0
    for html in htmls:
        page = Page(html)
        if pages and (nodes + len(page.parent) > FOREST_NODES or len(pages) >= FOREST_PAGES):
            close()
            nodes = 0
        pages.append(page)
        nodes += len(page.parent)
    if pages:
        close()
    return out


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "html"):
            texts = main_texts([x.decode("utf-8", "replace") for x in raw], shared.value)
            names = [n for n in part.schema.names if n != "html"]
            yield pa.record_batch([*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each page, its main text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(train())
    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return binary(pages, *keep, text="html").mapInArrow(_extract(shared), f"{types}, text string, n_chars long")
