"""Main text of HTML pages by a graphical model over the page's tree.

A page is parsed into a tree whose nodes are the block elements and, as leaves, the runs of text between them (inline markup joins a run). Every node
is content or not. A node's potential is linear in its tag, the words of its class, id and role, and in measures of its text (length,
link density, share of the page, neighbours); an edge's potential is a table by the child's kind. Sum-product message passing, upward then
downward, gives each node's exact marginal on a tree; leaves with a content marginal of at least one half make the text. All
pages of a slice of a batch pass their messages together, level by level, so the work is linear in the pages' size and in one task only by slice.

The parameters maximise the conditional likelihood of labelled pages; its gradient is exact, by the same messages. Labelled are `Settings.made` pages
that a fixed random grammar writes, and at most `Settings.sampled` pages of the table that have one article or main element, which labels
them by what stands in it. The fit runs in one task and its result is a vector of fixed length, which is broadcast.

Rules besides the model: scripts, styles, titles, templates, form controls and other elements that show no prose never give text; character references are
decoded as browsers do; white space (Unicode's) in a block becomes one space; blocks are joined by a line feed.

Edge cases: a null or empty page, and one without content, have the text "" and n_chars 0. Broken markup (unclosed, misnested or cut off tags,
comments and quotes) is read as browsers do in the main, in linear time. Repeated rows give repeated results; null ids pass through. Other columns are
never read and may bear any name.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_slices, texts_of

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Up to the end tag all is text, which is no prose.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Parsed like others, but what they hold is never text.
MUTE = frozenset("head noscript template select option button svg canvas audio video object map datalist".split())
#: A start tag closes an open element of the same family, if no element of the second set stands between.
CLOSES = {
    "p": frozenset("article aside body button div section td th li dd main table blockquote figure form header footer nav".split()),
    "li": frozenset("ul ol menu".split()), "dd": frozenset("dl".split()), "tr": frozenset("table".split()), "td": frozenset("table tr".split()), "option": frozenset("select".split()),
}
FAMILY = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
#: Elements that don't close an open p when they start.
IN_P = INLINE | VOID - {"hr"} | RAW | MUTE | frozenset("li dd dt tr td th tbody thead tfoot caption html body".split())
KINDS = {t: k for k, tags in enumerate(["", "p blockquote pre figure figcaption address", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dd dt", "div section center details", "article main", "nav aside header footer form dialog search fieldset", "table tbody thead tfoot tr td th caption", "html body"]) for t in tags.split()}
OTHER = 10
N_KINDS = 11

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++))|([^\s=/>\"']+)")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HASHED = 8192


@dataclass
class Nodes:
    """The nodes of a slice's pages, parents first. `chars`, `linked` and `ends` are of leaves; `text` is None for elements."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    fixed: list[list[int]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


def hashed(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % _HASHED


class Static(dict):
    """Feature numbers of an element by (tag, attributes), remembered up to a bound."""

    def __missing__(self, key: tuple[str, str]) -> list[int]:
        if len(self) > 50_000:
            self.clear()
        tag, attributes = key
        out = {"t:" + tag}
        for name, *values, bare in _ATTRIBUTE.findall(attributes):
            name, value = (name or bare).lower(), "".join(values)
            if name in ("class", "id", "role"):
                out.update("c:" + (w := x.lower()).removesuffix("s")[:24] if len(x) > 3 else "c:" + x.lower() for x in _TOKEN.findall(value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "none" in value):
                out.add("hidden")
        found = self[key] = sorted(map(hashed, out))
        return found


Labeller = Callable[[str, str], int | None]


def _tag_end(html: str, at: int, missing: set[str]) -> int:
    """Where the tag's `>` is, which is not in a quoted value; the length if there is none. `missing` holds quotes known not to come again."""
    n = len(html)
    while at < n:
        at = _PLAIN.match(html, at).end()
        if at >= n or html[at] == ">":
            return at
        quote = html[at]
        if quote not in missing and html[at - 1] in "= \t\n" and html[max(0, at - 20) : at].rstrip().endswith("="):
            end = html.find(quote, at + 1)
            if end < 0:
                missing.add(quote)
            else:
                at = end
        at += 1
    return n


def parse(html: str, page: int, nodes: Nodes, static: Static, labeller: Labeller | None = None) -> None:
    """Append the page's nodes: a root, block elements and leaves."""
    lower, n, at = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), html), len(html), 0
    root = len(nodes.parent)

    def add(parent: int, kind: int, fixed: list[int], text: str | None, linked: int, label: int) -> int:
        nodes.page.append(page)
        nodes.parent.append(parent)
        nodes.depth.append(nodes.depth[parent] + 1 if parent >= 0 else 0)
        nodes.kind.append(kind)
        nodes.fixed.append(fixed)
        nodes.text.append(text)
        nodes.linked.append(linked)
        nodes.label.append(label)
        return len(nodes.parent) - 1

    add(-1, OTHER, [], None, 0, 0)
    # Of each open element: tag, node (an inline one has its parent's), mute, label, where the innermost open element of each family stands, and
    # the number of open inline elements by tag since the innermost block.
    stack: list[tuple[str, int, bool, int, dict[str, int], dict[str, int]]] = [("", root, False, 0, {}, {})]
    opened: dict[str, int] = {}
    run: list[str] = []
    links = linked = 0
    missing: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                _, node, _, label, _, _ = stack[-1]
                add(node, 0, leaf_features(text, stack[-1][0]), text, min(linked, len(text)), label)
            run.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        if any(x[0] not in INLINE for x in stack[to:]):
            flush()
        while len(stack) > to:
            tag, _, _, _, _, inside = stack.pop()
            (inside if tag in INLINE else opened)[tag] -= 1
            links -= tag == "a"

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            text = unescape(raw) if "&" in raw else raw
            run.append(text)
            if links:
                linked += len(text.strip())

    raw_missing: set[str] = set()
    while at < n:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        name = _NAME.match(html, start + 1)
        if name is None:
            if html.startswith("<!--", start):
                say(html[at:start])
                end = html.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif html[start + 1 : start + 2] in ("!", "?", "/"):
                say(html[at:start])
                end = html.find(">", start)
                at = n if end < 0 else end + 1
            else:
                say(html[at : start + 1])
                at = start + 1
            continue
        say(html[at:start])
        end = _tag_end(html, name.end(), missing)
        at = end + 1
        if end >= n:
            break
        tag = lower[name.start(1) : name.end(1)]
        if html[start + 1] == "/":
            if (stack[-1][5] if tag in INLINE else opened).get(tag):
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                close(to)
            if tag == "br":
                say(" ")
            continue
        attributes = html[name.end() : end]
        if tag == "br" or tag == "wbr":
            say(" " if tag == "br" else "")
            continue
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            if tag not in raw_missing:
                over = lower.find("</" + tag, at)
                if over < 0:
                    raw_missing.add(tag)
                at = n if over < 0 else over
                after = html.find(">", at)
                at = n if after < 0 else after + 1
            continue
        family = FAMILY.get(tag) if tag in FAMILY else None if tag in IN_P else "p"
        marks = stack[-1][4]
        if family is not None and (to := marks.get(family, -1)) > 0:
            close(to)
            marks = stack[-1][4]
        _, node, mute, label, _, inside = stack[-1]
        if labeller is not None and (own := labeller(tag, attributes)) is not None:
            label = own
        inline = tag in INLINE
        if not inline:
            flush()
            mute = mute or tag in MUTE
            node = add(node, KINDS.get(tag, OTHER), static[tag, attributes], None, 0, label)
            kept = {f: k for f, k in marks.items() if tag not in CLOSES[f]} if marks else {}
            if tag in FAMILY:
                kept[FAMILY[tag]] = len(stack)
            marks, inside = kept, {}
        links += tag == "a"
        stack.append((tag, node, mute, label, marks, inside))
        count = inside if inline else opened
        count[tag] = count.get(tag, 0) + 1
    flush()


_ENDS = tuple(".!?:;…。！？\"'»”)")


def leaf_features(text: str, tag: str) -> list[int]:
    marked = "©" in text or "®" in text
    return _leaf(tag, text.endswith(_ENDS), marked)


def _leaf(tag: str, ends: bool, marked: bool, memo: dict = {}) -> list[int]:
    key = tag, ends, marked
    if key not in memo:
        memo[key] = sorted({hashed("leaf"), hashed(f"in:{tag}"), hashed(f"ends:{ends}"), *([hashed("marked")] if marked else [])})
    return memo[key]


#: Numbers of the measures' buckets: leaves' length, link density, lengths before and after, place; elements' length, link density, leaves, share, mean length.
_SIZES = [16, 5, 8, 8, 5, 24, 5, 16, 6, 16]
_FIRST = (_HASHED + np.concatenate([[0], np.cumsum(_SIZES)])).tolist()
N_FEATURES = _FIRST[-1]


@dataclass
class Forest:
    """Arrays of a slice's nodes for message passing: `levels` are node numbers by depth; features in CSR form."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    owner: np.ndarray
    feature: np.ndarray


def _log_bucket(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.log2(x + 1).astype(np.int64), most - 1)


def _part_bucket(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.searchsorted([0.0, 0.1, 0.35, 0.7], x / np.maximum(of, 1), side="left")


def forest(nodes: Nodes) -> Forest:
    parent, kind, depth, page = (np.array(x, np.int64) for x in (nodes.parent, nodes.kind, nodes.depth, nodes.page))
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    leaf = np.array([x is not None for x in nodes.text], bool)
    chars = np.array([len(x) if x is not None else 0 for x in nodes.text], np.int64)
    below = [chars.copy(), np.array(nodes.linked, np.int64), leaf.astype(np.int64)]
    for level in reversed(levels[1:]):
        for x in below:
            np.add.at(x, parent[level], x[level])
    owner, feature = [np.repeat(np.arange(n), [len(x) for x in nodes.fixed])], [np.array([f for x in nodes.fixed for f in x], np.int64)]

    def measure(which: int, at: np.ndarray, bucket: np.ndarray) -> None:
        owner.append(at)
        feature.append(_FIRST[which] + bucket)

    at = np.flatnonzero(leaf)
    if len(at):
        size, near = chars[at], _log_bucket(chars[at], 16) // 2
        same = page[at][1:] == page[at][:-1]
        before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        before[1:][same], after[:-1][same] = near[:-1][same], near[1:][same]
        # Characters of the page before a leaf, against those of the whole page (at its root, the first node of the page).
        root = np.flatnonzero(parent < 0)
        total = below[0][root][np.searchsorted(page[root], page[at])]
        run = np.cumsum(size) - size
        first = np.concatenate([[True], ~same])
        place = (run - run[np.flatnonzero(first)][np.cumsum(first) - 1]) / np.maximum(total, 1)
        for which, bucket in enumerate((_log_bucket(size, 16), _part_bucket(below[1][at], size), before, after, np.minimum((place * 5).astype(np.int64), 4))):
            measure(which, at, bucket)
    at = np.flatnonzero(~leaf & (parent >= 0))
    if len(at):
        root = np.flatnonzero(parent < 0)
        total = below[0][root][np.searchsorted(page[root], page[at])]
        size, linked, leaves = (x[at] for x in below)
        share = np.minimum((size / np.maximum(total, 1) * 6).astype(np.int64), 5)
        for which, bucket in enumerate((_log_bucket(size, 24), _part_bucket(linked, size), _log_bucket(leaves, 16), share, _log_bucket(size // np.maximum(leaves, 1), 16))):
            measure(5 + which, at, bucket)
    return Forest(parent, kind, levels, np.concatenate(owner), np.concatenate(feature))


@dataclass(frozen=True)
class Weights:
    """`node` is by feature, for content against not; `edge` by (kind of the child, the parent's state, the child's state)."""

    node: np.ndarray
    edge: np.ndarray


def marginals(f: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The content marginal of every node, and of every node with a parent the joint one with it, as (parent's state, own state); by sum-product.

    `own` is the log potential of content. Leaves start and each level sends its messages to the one above; then back.
    """
    n = len(own)
    inner = np.stack([np.zeros(n), own], 1)
    up = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        up[level] = np.logaddexp.reduce(edge[f.kind[level]] + inner[level][:, None, :], axis=2)
        np.add.at(inner, f.parent[level], up[level])
    belief, joint = inner.copy(), np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = belief[f.parent[level]] - up[level]
        both = rest[:, :, None] + edge[f.kind[level]] + inner[level][:, None, :]
        both -= np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]
        joint[level] = np.exp(both)
        belief[level] = inner[level] + np.logaddexp.reduce(rest[:, :, None] + edge[f.kind[level]], axis=1)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def potentials(f: Forest, w: Weights) -> np.ndarray:
    return np.bincount(f.owner, weights=w.node[f.feature], minlength=len(f.parent))


def fit(nodes: Nodes, rounds: int = 150, l2: float = 0.2) -> Weights:
    """Maximise the conditional log likelihood of the labels, less an L2 penalty, by exact gradients with Adam's steps."""
    f, y = forest(nodes), np.array(nodes.label, np.float64)
    child = np.flatnonzero(f.parent >= 0)
    state = y.astype(np.int64)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], state[f.parent[child]], state[child]), 1)
    have = np.bincount(f.feature, weights=y[f.owner], minlength=N_FEATURES)
    x = np.zeros(N_FEATURES + N_KINDS * 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        w = Weights(x[:N_FEATURES], x[N_FEATURES:].reshape(N_KINDS, 2, 2))
        p, joint = marginals(f, potentials(f, w), w.edge)
        expected = np.zeros((N_KINDS, 2, 2))
        np.add.at(expected, f.kind[child], joint[child])
        gradient = np.concatenate([have - np.bincount(f.feature, weights=p[f.owner], minlength=N_FEATURES), (seen - expected).ravel()]) - l2 * x
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x + 0.15 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Weights(x[:N_FEATURES].copy(), x[N_FEATURES:].reshape(N_KINDS, 2, 2).copy())


# -- labelled pages ----------------------------------------------------------------------------------------------------

_ROLES = {
    "menu": "nav navbar navigation menu main-menu topnav links toolbar tabs breadcrumb breadcrumbs pagination pager skip-links",
    "header": "header site-header masthead banner top topbar branding logo",
    "footer": "footer site-footer bottom colophon copyright legal page-footer",
    "side": "sidebar side aside widget widgets related related-posts more recommended popular trending teaser tags meta share social sharing author-box",
    "notice": "notice cookie cookies cookie-banner consent alert message warning popup modal overlay newsletter subscribe signup paywall announcement",
    "advert": "ad ads advert advertisement adsense sponsored sponsor promo promotion banner-ad ad-slot commercial",
    "comment": "comments comment comment-list replies reply discussion respond disqus user-comments reader-comments feedback responses",
    "content": "content article post entry main story text body article-body post-content entry-content main-content page-content prose blog-post",
}
_CLASSES = {k: v.split() for k, v in _ROLES.items()}
_SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "notice": "aside", "advert": "aside", "comment": "section", "content": "article"}


class Writer:
    """A random page whose content is marked by data-y; what is learnt from it are tags, names, shapes and lengths, not words."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        #: How long this page's paragraphs are: some pages hold fragments only, some a single long block.
        self.style = self.rng.choice(["plain", "plain", "short", "long", "same"])
        self.fragment = None
        self.vocabulary = ["".join(self.rng.choice("aeiourstnlbcdméñ") for _ in range(self.rng.randint(1, 9))) for _ in range(100)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.vocabulary, k=self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.rng.choice([".", ".", ".", "?", "!", ""]) for _ in range(self.rng.randint(low, high)))

    def prose(self) -> str:
        r = self.rng
        if self.style == "same" and r.random() < 0.85:
            self.fragment = self.fragment or self.words(1, 4) + r.choice([".", ""])
            return self.fragment
        if self.style in ("short", "same"):
            return self.words(1, 4) + r.choice([".", ".", ""]) if r.random() < 0.85 else self.sentences(1, 3)
        if self.style == "long" and r.random() < 0.3:
            return self.sentences(20, 60) if r.random() < 0.7 else self.words(200, 900)
        return self.sentences(1, 1) if r.random() < 0.25 else self.sentences(1, 9)

    def box(self, role: str, inner: str, label: int | None = None, tag: str | None = None) -> str:
        r = self.rng
        tag = tag or (_SEMANTIC[role] if r.random() < 0.5 else r.choice(["div", "div", "section"]))
        named = r.random() < (0.75 if tag == _SEMANTIC[role] != "section" else 0.96)
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(_CLASSES[role])}"' if named else ""
        mark = "" if label is None else f' data-y="{label}"'
        return f"<{tag}{name}{mark}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.75 else r.choice([" | ", " ", "<br>"]).join(items)

    def paragraph(self) -> str:
        r = self.rng
        text = self.prose()
        if r.random() < 0.2:
            text += f' <a href="x">{self.words(1, 3)}</a> {self.words(1, 5)}.'
        return f"<p><b>{text}<br>" if r.random() < 0.1 else f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{text}"

    def other(self) -> str:
        """A part that is no content."""
        r = self.rng
        role = r.choice(["menu", "side", "notice", "advert", "advert", "form", "comment"])
        if role == "menu":
            return self.box(role, self.links(2, 9), 0)
        if role == "side":
            return self.box(role, r.choice(["", f"<h3>{self.words(1, 4)}</h3>"]) + r.choice([self.links(2, 8), f"<p>{self.sentences(1, 2)}</p>", f"<p>{self.prose()}</p>"]), 0)
        if role == "form":
            return f'<form data-y="0"><label>{self.words(1, 3)}</label><input><p>{self.words(1, 9)}</p><button>{self.words(1, 2)}</button></form>'
        if role == "comment":
            one = [r.choice(["<div class=comment>{}</div>", "<li>{}</li>", "<article class=comment>{}</article>", "<div>{}</div>"]).format(r.choice(["", f"<h4>{self.words(1, 2)}</h4>"]) + f"<p>{self.prose()}</p>") for _ in range(r.randint(1, 6))]
            inner = r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(one)
            return self.box(role, f"<ol>{inner}</ol>" if r.random() < 0.3 else inner, 0)
        return self.box(role, r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f'<a href="/">{self.words(2, 8)}</a>']), 0)

    def content(self) -> str:
        r = self.rng
        parts = [self.paragraph() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 15, 25, *([60, 120] if self.style in ("short", "same") else [])]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            more = r.choice(["<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<pre>{}</pre>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<div>{}</div>", "<figure><figcaption>{}</figcaption></figure>"])
            parts.insert(r.randint(0, len(parts)), more.format(self.sentences(1, 1), self.sentences(1, 2)))
        if r.random() < 0.7:
            head = f"<h1>{self.words(2, 9)}</h1>"
            parts.insert(0, f"<header>{head}</header>" if r.random() < 0.25 else head)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(r.randint(1, len(parts)), self.other())
        return self.box("content", "".join(parts), 1, tag=r.choice(["article", "article", "main", None, None]))

    def page(self) -> str:
        r = self.rng
        head = f"<head><title>{self.words(2, 8)}</title></head>"
        top = [self.box("header", r.choice(["", f"<h1>{self.words(1, 3)}</h1>"]) + r.choice([self.links(2, 6), f"<p>{self.words(1, 6)}</p>", ""]) + self.words(0, 2), 0)] if r.random() < 0.6 else []
        top += [self.box("menu", self.links(2, 12), 0)] if r.random() < 0.7 else []
        top += [self.other() for _ in range(r.choice([0, 0, 1, 2]))]
        after = [self.other() for _ in range(r.choice([0, 0, 1, 2, 3]))]
        after += [self.box("footer", r.choice([f"&copy; {self.words(1, 4)}", f"<p>{self.words(2, 9)}</p>", self.links(2, 6), f"<p>© {self.words(1, 5)}</p>{self.links(1, 4)}", f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}"]), 0)] if r.random() < 0.8 else []
        body = self.content()
        if r.random() < 0.3:
            body = r.choice(["<div>{}</div>", '<div class="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>', '<div id="page">{}</div>']).format(body)
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{body}{''.join(after)}</body></html>"


def marked(tag: str, attributes: str) -> int | None:
    """Labels of written pages."""
    at = attributes.find("data-y=")
    return int(attributes[at + 8]) if at >= 0 else None


_APART = {x for k in ("menu", "footer", "side", "notice", "advert", "comment") for x in _CLASSES[k]}


def by_article(tag: str, attributes: str) -> int | None:
    """Labels of the table's pages: article and main hold content, but for the parts in them that are set apart by tag or name."""
    if tag in ("article", "main"):
        return 1
    if tag in ("nav", "aside", "footer", "form", "dialog"):
        return 0
    names = {x for name, *values, _ in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for x in "".join(values).lower().split()}
    return 0 if names & _APART else None


@dataclass(frozen=True)
class Settings:
    """The fit sees `made` written pages and at most `sampled` pages of the table, of up to `sampled_chars` characters each."""

    made: int = 500
    sampled: int = 150
    sampled_chars: int = 20_000
    rounds: int = 150
    threshold: float = 0.5


def labelled(pages: list[str], s: Settings = Settings()) -> Nodes:
    nodes, static = Nodes(), Static()
    for k in range(s.made):
        parse(Writer(k).page(), k, nodes, static, marked)
    for k, html in enumerate(pages):
        parse(html, s.made + k, nodes, static, by_article)
    return nodes


def train(pages: DataFrame, s: Settings = Settings()) -> Weights:
    """Fit in one task; what comes back is a vector of fixed length."""
    html = F.col("html").cast("string")
    fine = F.coalesce((F.length(html) <= s.sampled_chars) & (F.regexp_count(F.lower(html), F.lit("<(article|main)[\\s>]")) == 1), F.lit(False))
    rows = pages.select(F.col("page_id").cast("string").alias("id"), html.alias("html")).where(fine)
    rows = rows.select(F.xxhash64("id", "html").alias("h"), "html").orderBy("h", "html").limit(s.sampled)
    rows = rows.unionByName(pages.sparkSession.createDataFrame([(None, None)], "h long, html string"))  # so that there is a task for an empty table too

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((h, x) for b in batches for h, x in zip(b.column("h").to_pylist(), b.column("html").to_pylist()) if x is not None)
        w = fit(labelled([x for _, x in found], s), s.rounds)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (w.node, w.edge)], ["node", "edge"])

    (row,) = rows.repartition(1).mapInArrow(learn, "node binary, edge binary").collect()
    return Weights(np.frombuffer(row.node, "<f8"), np.frombuffer(row.edge, "<f8").reshape(N_KINDS, 2, 2))


def texts(pages: list[str], w: Weights, static: Static | None = None, threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    nodes, static = Nodes(), Static() if static is None else static
    for k, html in enumerate(pages):
        parse(html, k, nodes, static)
    out: list[list[str]] = [[] for _ in pages]
    if pages:
        f = forest(nodes)
        p, _ = marginals(f, potentials(f, w), w.edge)
        for k in np.flatnonzero(p >= threshold):
            if nodes.text[k] is not None:
                out[nodes.page[k]].append(nodes.text[k])
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, s: Settings = Settings(), weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page; no shuffle of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or train(pages, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        static = Static()
        for batch in text_slices(batches, "html", 2 << 20):
            found = texts(texts_of(batch, "html"), shared.value, static, s.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = [(F.col(f"`{c}`") if c in pages.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
