"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is read into a tree of its block elements and text runs (inline tags are transparent, unclosed
ones are closed as browsers do). Each node gets features: tag, tokens of its class, id and role, those of
its ancestors, depth, text and link density of its subtree, and its place and weight among its siblings.
Boosted trees give the probability that main text lies in the node. Decoding takes the most likely
assignment in which a node without main text has none below it and a node with main text
has a child with some; so an ancestor and a descendant never contradict each other.

The trees are trained here, on pages that ``sample_pages`` writes together with their labels: articles in
varied containers among menus, headers, footers, sidebars, notices, adverts, forms and comments.

A text run is a block: character references are decoded, white space becomes one space, ends are
trimmed, empty blocks go, and blocks are joined by one line feed. Scripts, styles, titles, comments
and a tag cut off by the page's end are never text. A null or empty page, or one without main text, gives "".
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math noframes xmp object".split())
#: An opening tag closes the open element of these, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
NO_PARAGRAPH = BLOCKS - {"p", "button", "option", "select", "head", "html", "body"}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z>][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style|y)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ENDS = {tag: re.compile(rf"</{tag}\s*[^>]*>|\Z", re.I) for tag in RAW}

GOOD = frozenset("article articlebody content main post story body entry text copy prose page blog".split())
BAD = {
    "menu": frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split()),
    "edge": frozenset("header footer masthead banner head foot copyright legal topbar bottom contentinfo".split()),
    "side": frozenset("sidebar side aside widget related recommended recommend more popular trending complementary rail".split()),
    "advert": frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion promoted dfp adsense".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert popup modal overlay message warning dialog paywall".split()),
    "talk": frozenset("comment comments commentlist reply replies respond discussion disqus thread reader".split()),
    "form": frozenset("form login signup subscribe newsletter search input register".split()),
    "share": frozenset("share sharing social tags tag meta byline author date rating".split()),
}
TAGS = ["run", "p", "div", "li", "ul", "article", "main", "section", "nav", "footer", "header", "aside", "form", "h1", "h2", "td", "blockquote", "body"]
MERGED = {"ol": "ul", "menu": "ul", "dl": "ul", "dt": "li", "dd": "li", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "th": "td", "pre": "blockquote", "figcaption": "p", "button": "form", "select": "form", "option": "form", "fieldset": "form", "html": "body"}
MARKS = ("good", *BAD)
ZONES = ("nav", "footer", "header", "aside", "form", "article", "main")
NAMES = [*TAGS, *(f"own {x}" for x in MARKS), *(f"above {x}" for x in MARKS), *(f"in {x}" for x in ZONES),
    "depth", "link share", "marks a word", "share of page", "share of parent", "place", "same tags", "hidden", "parent link share",
    "chars", "words", "links", "tags below", "chars a tag", "siblings", "before", "after", "longest", "runs", "page chars"]
KINDS = {t: tuple(int(MERGED.get(t, t) == x) for x in TAGS) for t in [*TAGS, *MERGED]}
NO_KIND, NO_MARKS = (0,) * len(TAGS), (0,) * len(MARKS)


class Node:
    __slots__ = ("tag", "up", "marks", "text", "links", "link_chars", "kids", "hidden", "label", "tags")

    def __init__(self, tag: str, up: int, marks: tuple = (), hidden: bool = False, label: int = -1):
        self.tag, self.up, self.marks, self.hidden, self.label = tag, up, marks, hidden, label
        self.text, self.links, self.link_chars, self.tags, self.kids = "", 0, 0, 0, []


@lru_cache(maxsize=1 << 14)
def attributes(source: str) -> tuple[tuple[int, ...], bool, int]:
    """Marks of the class, id and role tokens; whether the element is hidden; its label, if it has one."""
    found, hidden, label = set(), False, -1
    for name, a, b, c in ATTRIBUTE.findall(source):
        value, name = a or b or c, name.lower()
        if name == "y":
            label = int(value == "1")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name != "style":
            tokens = {t.lower() for t in TOKEN.findall(value)}
            found |= {i for i, k in enumerate(MARKS) if tokens & (GOOD if k == "good" else BAD[k])}
    return tuple(sorted(found)), hidden, label


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; node 0 is the root."""
    nodes = [Node("html", -1)]
    stack, links, parts = [("html", 0)], 0, []  # open elements: tag, node (inline ones have their block's)
    places: dict[str, list[int]] = {}  # where in the stack a tag is open; "" for all blocks

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(x for x, _ in parts)).split())
            if text:
                block = stack[-1][1]
                run = Node("run", block)
                run.text = text
                run.link_chars = sum(len(x) for x, inside in parts if inside)
                run.links = sum(inside > 0 for x, inside in parts if x.strip())
                nodes[block].kids.append(len(nodes))
                nodes.append(run)
            parts = []

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            places.setdefault("", []).append(len(stack))
        stack.append((tag, node))

    def innermost(names) -> int:
        return max((p[-1] for x in names if (p := places.get(x))), default=0)

    def shut(names, limits=()) -> None:
        """Closes the innermost open element of these names, unless one of the limits is open inside it, and what is open inside it.

        Places are looked up, not searched for: a deep page takes no longer than a flat one.
        """
        nonlocal links
        i = innermost(names)
        if not i or innermost(limits) > i:
            return
        if any(tag in BLOCKS for tag, _ in stack[i:]):
            flush()
        while len(stack) > i:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag in BLOCKS:
                places[""].pop()
            links -= tag == "a"

    at = 0
    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append((text, links))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                parts.append((" ", 0))
            else:
                shut({tag}, {"body"} if tag in BLOCKS else {""})
            continue
        nodes[stack[-1][1]].tags += 1
        if tag in RAW:
            if not m[3].endswith("/"):
                at = ENDS[tag].search(page, at).end()
            continue
        if tag in BLOCKS:
            if tag in ("html",):
                continue
            if tag in CLOSES:
                shut(*CLOSES[tag])
            if tag in NO_PARAGRAPH or tag == "p":
                shut({"p"}, {"td", "th", "button", "li", "div", "body"} if tag == "p" else {"td", "th", "button", "body"})
            flush()
            if tag in VOID:
                continue
            block = stack[-1][1]
            marks, hidden, label = attributes(m[3]) if m[3] else ((), False, -1)
            nodes[block].kids.append(len(nodes))
            push(tag, len(nodes))
            nodes.append(Node(tag, block, marks, hidden, label))
        elif tag in VOID:
            parts.append((" ", 0) if tag == "br" else ("", 0))
        elif not m[3].endswith("/"):
            links += tag == "a"
            push(tag, stack[-1][1])
    flush()
    return nodes


def features(nodes: list[Node]) -> list[tuple]:
    """One row of NAMES for each node."""
    n = len(nodes)
    chars, words, link_chars, links, marks, tags, longest, runs = ([0] * n for _ in range(8))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "run":
            chars[i] = longest[i] = len(x.text)
            words[i], link_chars[i], links[i], runs[i] = x.text.count(" ") + 1, min(x.link_chars, len(x.text)), x.links, 1
            marks[i] = sum(map(x.text.count, ",.;:!?"))
        tags[i] += x.tags
        if x.up >= 0:
            u = x.up
            for total in (chars, words, link_chars, links, marks, tags, runs):
                total[u] += total[i]
            longest[u] = max(longest[u], longest[i])
    page = max(1, chars[0])
    above: list[tuple] = [(0,) * len(MARKS)] * n
    inside: list[tuple] = [(0,) * len(ZONES)] * n
    depth, place, same = [0] * n, [0] * n, [1.0] * n
    for x in nodes:
        if x.kids:
            tally: dict[str, int] = {}
            for j, kid in enumerate(x.kids):
                place[kid] = j
                tally[nodes[kid].tag] = tally.get(nodes[kid].tag, 0) + 1
            for kid in x.kids:
                same[kid] = tally[nodes[kid].tag] / len(x.kids)
    out = []
    for i, x in enumerate(nodes):
        u, j, own = x.up, place[i], NO_MARKS
        if x.marks:
            own = tuple(int(k in x.marks) for k in range(len(MARKS)))
        if u >= 0:
            p = nodes[u]
            depth[i] = depth[u] + 1
            above[i] = tuple(int(a or k in p.marks) for k, a in enumerate(above[u])) if p.marks else above[u]
            inside[i] = tuple(int(a or p.tag == t) for a, t in zip(inside[u], ZONES, strict=True)) if p.tag in ZONES else inside[u]
            siblings, parent_chars, parent_links = p.kids, chars[u] or 1, link_chars[u]
        else:
            siblings, parent_chars, parent_links = [i], page, 0
        count, c = len(siblings), chars[i]
        before, after = (chars[siblings[j - 1]] if j else 0), (chars[siblings[j + 1]] if j + 1 < count else 0)
        out.append((*KINDS.get(x.tag, NO_KIND), *own, *above[i], *inside[i], depth[i], link_chars[i] / (c or 1), marks[i] / (words[i] or 1), c / page, c / parent_chars, j / count, same[i], int(x.hidden), parent_links / parent_chars, c, words[i], links[i], tags[i], c / (1 + tags[i]), count, before, after, longest[i], runs[i], page))
    return out


def decode(nodes: list[Node], p: np.ndarray) -> list[str]:
    """Runs of the most likely consistent assignment, in page order."""
    yes, no = np.log(np.clip(p, 1e-9, 1)).tolist(), np.log(np.clip(1 - p, 1e-9, 1)).tolist()
    n = len(nodes)
    with_text, without = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        kids = nodes[i].kids
        without[i] = no[i] + sum(without[k] for k in kids)
        if nodes[i].tag == "run":
            with_text[i] = yes[i]
        elif kids:
            # At least one child has main text: else the least costly one is made to.
            total, forced = 0.0, -math.inf
            for k in kids:
                total += max(with_text[k], without[k])
                forced = max(forced, min(0.0, with_text[k] - without[k]))
            with_text[i] = yes[i] + total + forced
        else:
            with_text[i] = -math.inf
    if with_text[0] <= without[0]:
        return []
    chosen, todo = [], [0]
    while todo:
        i = todo.pop()
        if nodes[i].tag == "run":
            chosen.append(i)
            continue
        kids = nodes[i].kids
        take = [k for k in kids if with_text[k] > without[k]]
        todo += take or [max(kids, key=lambda k: with_text[k] - without[k])]
    return [nodes[i].text for i in sorted(chosen)]


class Boosted:
    """Gradient-boosted trees of a fixed depth on binned features, logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, x[:, j], side="right") for j, edges in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [e if len(np.unique(x[:, j])) > 2 else np.array([0.5]) for j, e in enumerate(self.edges)]
        b, f = self.binned(x), x.shape[1]
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score, self.split, self.cut, self.leaf = np.full(len(y), self.start), [], [], []
        column = np.arange(f)[None, :] * self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, split, cut = np.zeros(len(y), int), np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, 255)
            for level in range(self.depth):
                base, wide = 2**level - 1, 2**level
                key = ((node - base)[:, None] * (f * self.bins) + column + b).ravel()
                gs = np.bincount(key, np.repeat(g, f), wide * f * self.bins).reshape(wide, f, self.bins).cumsum(2)
                hs = np.bincount(key, np.repeat(h, f), wide * f * self.bins).reshape(wide, f, self.bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(wide, -1).argmax(1)
                some = gain.reshape(wide, -1).max(1) > 1e-9
                split[base : base + wide] = np.where(some, best // self.bins, 0)
                cut[base : base + wide] = np.where(some, best % self.bins, 255)
                node = 2 * node + 1 + (b[np.arange(len(y)), split[node]] > cut[node])
            last = node - (2**self.depth - 1)
            value = self.rate * np.bincount(last, g, 2**self.depth) / (np.bincount(last, h, 2**self.depth) + 1)
            score += value[last]
            self.split.append(split)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x).ravel()
        score, row = np.full(len(x), self.start), np.arange(len(x)) * x.shape[1]
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b.take(row + split.take(node)) > cut.take(node))
            score += leaf.take(node - (2**self.depth - 1))
        return 1 / (1 + np.exp(-score))


def sample_pages(n: int, seed: int = 7) -> list[str]:
    """Labelled pages: an attribute y of 1 or 0 says whether the text below is main text."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("an", "be", "co", "du", "er", "fi", "go", "hu", "il", "ki", "lo", "mo", "ne", "or", "pa", "re", "st", "tu", "ve") for _ in range(rng.integers(1, 5)))

    def line(low: int, high: int) -> str:
        out = []
        for _ in range(int(math.exp(rng.uniform(math.log(low), math.log(high))))):
            out.append(word() + pick("", "", "", "", "", ",", ".", " &amp; x"))
        return " ".join(out).capitalize() + pick(".", ".", "")

    def linked(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{line(1, 4)}</a></li>' for _ in range(k))

    def attr(*names: str) -> str:
        if chance(0.35):
            return ""
        return f' {pick("class", "id", "class")}="{pick(*names)}{pick("", "", " wide", "-1", " col-md-4")}"'

    def junk(*names: str, tags: tuple = ("div",), low: int = 2, high: int = 40, listed: float = 0.3) -> str:
        tag = pick(*tags)
        body = f"<ul>{linked(rng.integers(2, 9))}</ul>" if chance(listed) else pick("{}", "<p>{}</p>", "<span>{}</span>", "<h3>x</h3><p>{}</p>").format(line(low, high))
        named = f' {pick("class", "id", "class")}="{pick(*names)}"' if tag in ("div", "section", "ul") else attr(*names)
        return f'<{tag} y="0"{named}>{body}</{tag}>'

    def paragraphs() -> str:
        out = []
        for _ in range(int(math.exp(rng.uniform(0, math.log(25))))):
            kind = rng.random()
            text = line(1, 150) if chance(0.3) else line(12, 150)
            if chance(0.15):
                text = f'{text} <a href="/{word()}">{line(1, 3)}</a> {line(1, 20)}'
            if kind < 0.66:
                out.append(f"<p>{text}</p>")
            elif kind < 0.78:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.84:
                out.append(f"<h2>{line(1, 8)}</h2><p>{text}</p>")
            elif kind < 0.89:
                out.append(f"<ul>{''.join(f'<li>{line(2, 25)}</li>' for _ in range(rng.integers(1, 6)))}</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.94:
                out.append(f"<table><tr><td>{line(1, 9)}</td><td>{line(1, 9)}</td></tr></table>")
            elif kind < 0.96:
                out.append(f"<div>{text}</div>")
            else:
                out.append(pick(junk("ad", "advert", "ad-slot", "sponsored", "promo"), junk("share", "social"), junk("related", "more"), junk("newsletter", "subscribe", tags=("form", "div"))))
        return "".join(out)

    pages = []
    for _ in range(n):
        brief = chance(0.2)
        head = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>t t t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        parts = [head]
        nav = f'<nav y="0"{attr("nav", "menu", "navbar")}><ul>{linked(rng.integers(2, 12))}</ul></nav>' if chance(0.6) else f'<div y="0" class="{pick("nav", "menu", "navbar", "top-nav")}"><ul>{linked(rng.integers(2, 12))}</ul></div>'
        title = f"<h1>{line(2, 12)}</h1>"
        if chance(0.35):
            parts.append(f'<header y="0"{attr("header", "masthead")}>{pick("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>").format(line(1, 12))}{nav if chance(0.5) else ""}</header>')
        if chance(0.85):
            parts.append(nav)
        for _ in range(rng.integers(0, 3)):
            parts.append(pick("<!-- ad -->", "") + pick(junk("ad", "ads", "advert", "banner-ad", "sponsor"), junk("cookie", "cookie-notice", "consent", "notice", "alert"), junk("breadcrumb", "breadcrumbs"), junk("search", "login", tags=("form",))))
        side = junk("sidebar", "side", "widget", "related", tags=("aside", "div", "aside"), high=90, listed=0.5) if chance(0.35) else ""
        body = f"<h1>{line(1, 6)}</h1><p>{line(1, 12)}</p>" if brief else (title if chance(0.9) else "") + (junk("byline", "meta", "author", low=1, high=8, listed=0) if chance(0.15) else "") + paragraphs()
        kind = rng.random()
        if kind < 0.5:
            main = f'<article y="1"{attr("post", "entry", "article") if chance(0.5) else ""}>{body}</article>'
        elif kind < 0.62:
            main = f'<main y="1">{body}</main>'
        elif kind < 0.9:
            main = f'<{(t := pick("div", "div", "section"))} y="1" {pick("class", "id")}="{pick("content", "article", "post", "main", "story", "entry-content", "article-body", "text")}">{body}</{t}>'
        else:
            main = f'<div y="1">{body}</div>'
        if chance(0.3):
            main = f'<{(t := pick("div", "main", "section"))}{attr("wrapper", "container", "page", "main")}>{main}{side}</{t}>'
        else:
            parts.append(side if chance(0.5) else "")
            main += side if chance(0.5) else ""
        parts.append(main)
        if chance(0.35):
            tag = pick("div", "section", "ul")
            one = "li" if tag == "ul" else pick("div", "article", "p")
            parts.append(f'<{tag} y="0" {pick("class", "id")}="{pick("comments", "comment-list", "commentlist", "discussion", "replies")}">' + "".join(f'<{one} class="{pick("comment", "reply", "")}">{pick("<p>{}</p>", "{}").format(line(3, 90))}</{one}>' for _ in range(rng.integers(1, 6))) + f"</{tag}>")
        if chance(0.3):
            parts.append(pick(junk("newsletter", "subscribe", "signup", tags=("form", "div")), junk("related", "recommended", "more", high=60), junk("notice", "cookie", "popup", "modal")))
        if chance(0.85):
            parts.append(f'<footer y="0"{attr("footer")}>&copy; {line(1, 30)}</footer>' if chance(0.7) else f'<div y="0" class="{pick("footer", "copyright", "foot")}">&copy; {line(1, 30)}</div>')
        pages.append("".join(parts) + ("</body></html>" if chance(0.85) else ""))
    return pages


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    nodes = parse(page)
    state, y = [0] * len(nodes), np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        state[i] = x.label if x.label >= 0 else state[x.up] if x.up >= 0 else 0
        if x.tag == "run" and state[i]:
            j = i
            while j >= 0 and not y[j]:
                y[j] = 1
                j = nodes[j].up
    return nodes, y


@lru_cache(maxsize=1)
def trained(pages: int = 500) -> Boosted:
    rows, labels = [], []
    for page in sample_pages(pages):
        nodes, y = labelled(page)
        rows += features(nodes)
        labels += y.tolist()
    return Boosted().fit(np.array(rows), np.array(labels))


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p) if p else [] for p in pages]
    rows = [row for t in trees for row in features(t)] if any(trees) else []
    p = model.predict(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for t in trees:
        out.append("\n".join(decode(t, p[at : at + len(t)])) if t else "")
        at += len(t)
    return out


def extract(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows: int = 256, chars: int = 4 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < len(batch):
                # Parts of a bounded number of rows and characters, at least one row.
                part, size, end = [], 0, start
                while end < len(batch) and end - start < rows and (end == start or size < chars):
                    part.append(batch.column("html")[end].as_py())
                    size += len(part[-1] or "")
                    end += 1
                texts = main_texts(part, shared.value)
                cut = batch.slice(start, end - start)
                yield pa.record_batch([cut.column("page_id"), cut.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                start = end

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
