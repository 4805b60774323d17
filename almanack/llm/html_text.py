"""Main text of web pages by gradient-boosted trees over DOM nodes.

Pages are parsed leniently into nodes. Each element gets features: its tag's kind, tokens of its class, id
and role, depth, size and density of its subtree, share of text in links, sibling statistics, and
the same tokens anywhere above it. Two ensembles of trees, fitted by Newton boosting on the logistic
loss, give the chance that a node belongs to the article and that it is a container of it. They
are trained on a bounded number of pages built from varied templates with known articles, and of
given pages with semantic tags, whose article is known from these tags.

Decoding goes down the tree: a node's chance is joined with its ancestors', a node that is surely
outside takes its whole subtree with it, and no descendant of a rejected node is accepted, so that an
ancestor and a descendant never contradict each other. Blocks are runs of text between block
tags; character references are decoded, white space inside a block is one space, blocks are trimmed,
empty ones left out, and the others joined in page order by one line break.

A NULL or empty page gives an empty text. A run of text and inline elements directly in the body is
a node of its own and judged like others.
Very long, deeply nested and broken pages are handled without recursion, in proportion to their size. Rows are independent, so NULL ids
and repeated rows need no care. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import smallest

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea"}  # text up to the end tag, or to the page's end without one
HIDDEN = {"noscript", "iframe", "template", "svg", "math", "object", "canvas", "select"}  # left out with what is in them
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "ul",
}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RUN = "#run"  # the tag of a run of text and inline elements that stands in the body itself
BARRIERS = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "td", "th", "blockquote", "main", "aside", "nav", "form"}

#: Tokens of class, id and role that say what a box is for, by purpose.
HINTS = {
    "menu": {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "topbar", "links"},
    "frame": {"header", "masthead", "banner", "footer", "foot", "copyright", "legal", "site", "contentinfo", "colophon"},
    "side": {"sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "more", "rail", "complementary", "archive", "tags"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense", "adbox", "outbrain", "taboola"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "toast", "warning"},
    "comment": {"comment", "comments", "reply", "replies", "discussion", "disqus", "responses", "respond", "commentlist", "reader"},
    "form": {"form", "search", "login", "register", "share", "social", "sharing", "buttons", "button", "toolbar", "rating", "vote"},
    "main": {"article", "main", "content", "post", "entry", "story", "body", "text", "prose", "page", "markdown"},
}
KINDS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "li", "h1", "h2", "table", "td", "blockquote", "figure", "a", "button", "body", RUN]
COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
#: A tag whose quotes may hold >, or the beginning of what never ends in this way (no name).
TAG = re.compile(COMMENT + "|" + NAME + r"((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<(?=[!?]|/?[a-zA-Z])", re.S)
#: A tag that ends at the next >, whatever its quotes.
PLAIN_TAG = re.compile(COMMENT + "|" + NAME + r"([^>]*)>", re.S)
HIDDEN_TAG = re.compile(rf"<(/?)({'|'.join(sorted(HIDDEN))})(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACE = re.compile(r"\s+")


# ---------------------------------------------------------------- parsing


@dataclass
class Page:
    """Nodes in page order: tag, parent, attribute tokens; pieces of text with their node."""

    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    hints: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    pieces: list[tuple[int, str | None]] = field(default_factory=list)  # text None: a block ends


def hints_of(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    words: set[str] = set()
    for _, value in ATTRIBUTE.findall(attributes):
        words.update(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
    return frozenset(name for name, tokens in HINTS.items() if words & tokens)


def tags_of(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, "/" or "", lower-case name and attributes of tags; comments and the like have no name.

    Send a place to go on from there. Each character is looked at a bounded number of times: once a tag
    isn't ended outside of quotes, tags end at the next > on the rest of the page, and behind the last > there are none.
    """
    at, pattern, last = 0, TAG, source.rfind(">") + 1
    while match := pattern.search(source, at) if pattern is TAG else pattern.search(source, at, max(at, last)):
        at = match.end()
        if match[2] is None:
            if at == match.start() + 1:  # the beginning of a tag without an end
                at, pattern = match.start(), PLAIN_TAG
                continue
            if match[0].startswith("<!--") and not match[0].endswith("-->"):
                at = len(source)
        at = (yield match.start(), at, match[1] or "", (match[2] or "").lower(), match[3] or "") or at


def hidden_ends(source: str) -> dict[int, int]:
    """Where hidden elements that have an end tag end, by the place of their start tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for match in HIDDEN_TAG.finditer(source):
        places = opened.setdefault(match[2].lower(), [])
        if not match[1]:
            places.append(match.start())
        elif places:
            ends[places.pop()] = match.end()
    return ends


class Stack:
    """The open nodes of a page, with counts of the tags that an end tag or a new block may close."""

    def __init__(self, page: Page) -> None:
        self.page, self.nodes, self.hidden = page, [0], 0
        self.open: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # since each open element that isn't inline
        self.scopes: list[Counter[str]] = [Counter()]  # from each open barrier on

    def push(self, tag: str, hints: frozenset[str], *, leaf: bool = False) -> None:
        self.page.tags.append(tag)
        self.page.parents.append(self.nodes[-1])
        self.page.hints.append(hints)
        if leaf:
            return
        self.nodes.append(len(self.page.tags) - 1)
        self.open[tag] += 1
        self.hidden += tag in HIDDEN
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.inline.append(Counter())
        if tag in BARRIERS:
            self.scopes.append(Counter())
        self.scopes[-1][tag] += 1

    def pop(self) -> str:
        tag = self.page.tags[self.nodes.pop()]
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        self.scopes[-1][tag] -= 1
        if tag in BARRIERS:
            self.scopes.pop()
        return tag

    def closes(self, tag: str) -> bool:
        """Whether an end tag has something to close: inline elements don't reach beyond their block."""
        return (self.inline[-1] if tag in INLINE else self.open)[tag] > 0

    def in_run(self) -> bool:
        return len(self.nodes) > 1 and self.page.tags[self.nodes[1]] == RUN


def parse(source: str) -> Page:
    """A tree without head, scripts and the like; unclosed elements end where HTML ends them.

    A hidden element without an end tag ends where its parent does. The work is in proportion to the page.
    """
    page, at = Page(), 0
    stack, ends = Stack(page), None

    def text(piece: str) -> None:
        if stack.hidden:
            return
        if len(stack.nodes) == 1 and piece.strip():
            stack.push(RUN, frozenset())
        if piece:
            page.pieces.append((stack.nodes[-1], piece))

    found = tags_of(source)
    tag = next(found, None)
    while tag:
        start, stop, closing, name, attributes = tag
        text(source[at:start])
        at = stop
        if not closing and name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
        elif not closing and name in HIDDEN:
            ends = hidden_ends(source) if ends is None else ends
            if start in ends:
                at = max(at, source.find(">", ends[start]) + 1 or len(source))
            elif not attributes.rstrip().endswith("/"):
                stack.push(name, frozenset())
        elif name in ("html", "body", "head", "meta", "link", "base", ""):
            if name in ("head", "body"):
                page.pieces.append((stack.nodes[-1], None))
        elif closing:
            if stack.closes(name):
                if name not in INLINE:
                    page.pieces.append((stack.nodes[-1], None))
                while stack.pop() != name:
                    pass
        elif name in VOID:
            if name in ("br", "hr"):
                page.pieces.append((stack.nodes[-1], None))
        else:
            if name not in INLINE:
                page.pieces.append((stack.nodes[-1], None))
            close = SELF_CLOSING.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            if any(stack.scopes[-1][tag] > 0 for tag in close):
                while stack.pop() not in close:
                    pass
            if stack.in_run() and name not in INLINE:
                while len(stack.nodes) > 1:  # a block ends the run
                    stack.pop()
            elif len(stack.nodes) == 1 and name in INLINE:
                stack.push(RUN, frozenset())
            stack.push(name, hints_of(attributes), leaf=attributes.endswith("/"))
        try:
            tag = found.send(at)
        except StopIteration:
            tag = None
    text(source[at:])
    return page


# ---------------------------------------------------------------- features


PLACES = {tag: place for place, tag in enumerate(KINDS)}
NAMES = {name: place for place, name in enumerate(HINTS)}
BLOCK_TAGS = {"p", "h1", "h2", "h3", "blockquote", "pre"}


def features(page: Page) -> np.ndarray:
    """A row per node. Sums and sets of flags are gathered in one walk up and one down the tree."""
    n, parents = len(page.tags), page.parents
    own_text, commas = [0] * n, [0] * n
    for node, piece in page.pieces:
        if piece is not None:
            own_text[node] += len(piece.strip())
            commas[node] += piece.count(",") + piece.count(".")
    total, count, siblings = own_text.copy(), [1] * n, [0] * n
    linked = [size if tag == "a" else 0 for size, tag in zip(own_text, page.tags, strict=True)]
    blocks = [int(tag in BLOCK_TAGS) for tag in page.tags]
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = parents[i]
        total[up] += total[i]
        commas[up] += commas[i]
        count[up] += count[i]
        linked[up] += linked[i]
        blocks[up] += blocks[i]
        siblings[up] += 1
    depth, position, seen = [0] * n, [0] * n, [0] * n
    hints, hints_above, kinds, kinds_above = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n):
        place = PLACES.get(page.tags[i])
        kinds[i] = 0 if place is None else 1 << place
        if page.hints[i]:
            hints[i] = sum(1 << NAMES[name] for name in page.hints[i])
        up = parents[i]
        if up >= 0:
            depth[i], position[i] = depth[up] + 1, seen[up]
            seen[up] += 1
            hints_above[i] = hints_above[up] | hints[up]
            kinds_above[i] = kinds_above[up] | (kinds[up] & 63)
    numbers = np.array([depth, total, count, linked, commas, blocks, siblings, position, own_text], np.float64)
    depth_, total_, count_, linked_, commas_, blocks_, siblings_, position_, own_ = numbers
    up = np.maximum(np.array(parents), 0)
    share = linked_ / (total_ + 1)
    columns = [
        depth_, np.log1p(total_), total_ / max(1.0, total_[0]), total_ / count_, share, commas_ / (total_ + 1), np.log1p(blocks_),
        siblings_, position_, siblings_[up], total_ / (total_[up] + 1), np.log1p(own_), share[up], np.log1p(count_),
    ]
    flags = np.array([hints, hints_above, kinds, kinds_above], np.int64)
    widths = (len(HINTS), len(HINTS), len(KINDS), 6)
    bits = [(f[:, None] >> np.arange(w)) & 1 for f, w in zip(flags, widths, strict=True)]
    return np.hstack([np.stack(columns, axis=1), *bits])


# ---------------------------------------------------------------- boosted trees


@dataclass
class Boosted:
    """Trees of fixed depth over binned features: per tree the feature, cut and values of its nodes."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for which, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting on the logistic loss with histograms of gradients, level by level."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total, trees, inner = np.full(len(y), base), [], 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        which, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for f in range(x.shape[1]):
                key = (node - first) * bins + binned[:, f]
                g = np.bincount(key, gradient, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, weight, width * bins).reshape(width, bins).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    which[first + np.flatnonzero(better)] = f
                    cut[first + np.flatnonzero(better)] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + ridge)
        total += value[leaf]
        trees.append((which, cut, value))
    return Boosted(edges, trees, base, depth)


# ---------------------------------------------------------------- training pages

OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
OUTSIDE_HINTS = {"menu", "frame", "side", "advert", "notice", "comment", "form"}


def truth(page: Page) -> np.ndarray | None:
    """1 for nodes of the article, where semantic tags tell; None for pages that have none."""
    roots = [i for i, t in enumerate(page.tags) if t == "article"] or [i for i, t in enumerate(page.tags) if t == "main"]
    if not roots:
        return None
    inside = np.zeros(len(page.tags))
    root = set(roots)
    for i in range(1, len(page.tags)):
        up = page.parents[i]
        out = page.tags[i] in OUTSIDE or page.hints[i] & OUTSIDE_HINTS
        inside[i] = (i in root or inside[up]) and (i in root or not out)
    return inside


def template_pages(count: int, seed: int = 3) -> Iterator[tuple[str, None]]:
    """Pages of varied templates: boxes of every purpose around and inside an article.

    The article is marked by an attribute that parsing ignores; ``labelled`` reads it.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    pick = lambda items: items[int(random.integers(len(items)))]
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(int(random.integers(2, 10))))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + pick([".", ".", "!", "?"])
    prose = lambda: " ".join(sentence(int(random.integers(4, 18))) for _ in range(int(random.integers(1, 6))))
    links = lambda k: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def linked() -> str:
        """Prose, at times with inline elements inside its sentences."""
        if random.random() < 0.6:
            return prose()
        inline = [f"<{tag}>{word()} {word()}</{tag.split()[0]}>" for tag in (f'a href="/{word()}"', "em", "b", 'span class="x"')]
        return " ".join(f"{prose()[:-1]} {pick(inline)} {prose()}" for _ in range(int(random.integers(1, 4))))

    def box(purpose: str) -> str:
        token = pick(sorted(HINTS[purpose]))
        tag = {"menu": ["nav", "div", "ul"], "frame": ["header", "footer", "div"], "side": ["aside", "div", "section"], "form": ["form", "div"]}.get(purpose, ["div", "section", "div"])
        tag = pick(tag)
        plain = tag in ("nav", "header", "footer", "aside", "form") and random.random() < 0.5
        mark = "" if plain else f' {pick(["class", "id"])}="{pick([token, f"{token}-{word()}", f"{word()} {token}"])}"'
        inner = {
            "menu": f"<ul>{links(int(random.integers(3, 9)))}</ul>", "frame": pick([f"<p>&copy; {word()} {sentence(4)}</p>", f"&copy; {word()}"]),
            "side": f"<h3>{word()}</h3><ul>{links(4)}</ul>" + (f"<p>{prose()}</p>" if random.random() < 0.4 else ""),
            "form": f"<label>{word()}</label><input name=q><button>{word()}</button>",
        }.get(purpose, "".join(f"<p>{prose()}</p>" for _ in range(int(random.integers(1, 4)))) if random.random() < 0.5 else prose())
        return f"<{tag}{mark}>{inner}</{tag}>"

    for _ in range(count):
        purposes = [p for p in HINTS if p != "main"]
        parts = []
        for _ in range(int(random.integers(1, 14))):
            kind = random.random()
            if kind < 0.75:
                parts.append(f"<p>{linked()}" + pick(["</p>", "</p>", ""]))
            elif kind < 0.83:
                parts.append(f"<h2>{sentence(4)}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.97:
                parts.append(f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>")
            else:
                parts.append(f'<div data-out="1">{box(pick(purposes))}</div>')
        body = f"<h1>{sentence(6)}</h1>" + "".join(parts)
        shape = pick(["article", "article", "main", "div", "section"])
        token = f' class="{pick(sorted(HINTS["main"]))}"' if shape in ("div", "section") or random.random() < 0.3 else ""
        article = f'<{shape}{token} data-in="1">{body}</{shape}>'
        before = "".join(box(pick(purposes)) for _ in range(int(random.integers(1, 4))))
        after = "".join(box(pick(purposes)) for _ in range(int(random.integers(1, 4))))
        middle = f"<div>{article}{after}</div>" if random.random() < 0.4 else article + after
        if random.random() < 0.15:  # the article lies in the body itself
            marked = f'<h1 data-in="1">{sentence(6)}</h1>' * int(random.random() < 0.7)
            for _ in range(int(random.integers(1, 6))):
                run = pick(["", f"<b>{word()}</b> "]) + prose() + pick(["", "<br>", "<br><br>", f" <i>{word()}</i> "]) + prose()
                marked += run + f'<p data-in="1">{prose()}</p>' * int(random.random() < 0.6)
            strip = " | ".join(f'<a data-out="1" href="/{word()}">{word()}</a>' for _ in range(int(random.integers(2, 7))))
            few = f'<div class="menu"><ul>{links(3)}</ul></div>'
            tops, ends = [before, "", strip + "<hr><div></div>", few], [after, "", "<div></div>" + strip, f'<div></div><span data-out="1">&copy; {word()} {word()}</span>']
            before, middle = pick(tops), marked + pick(ends)
        elif random.random() < 0.2:  # stray text around it
            middle += pick([f'<span data-out="1">&copy; {word()}</span> {word()} 2020', f'{word()} <a data-out="1" href="/{word()}">{word()}</a>', f'<i data-out="1">{sentence(5)}</i>'])
        yield f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{before}{middle}</body></html>", None


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A template page and 1 for its article's nodes."""
    marks = [m for m in TAG.finditer(source) if m[2]]
    page = parse(source)
    opened = [m[3] for m in marks if not m[1] and m[2].lower() not in VOID | {"html", "body", "head", "meta", "link", "title"}]
    rest = iter(opened)
    marks = ["", *("" if tag == RUN else next(rest) for tag in page.tags[1:])]
    out = {up for up, mark in zip(page.parents, marks, strict=True) if "data-out" in mark}
    inside = np.zeros(len(page.tags))
    for i in range(1, len(page.tags)):
        if page.tags[i] == RUN:
            inside[i] = i not in out
        else:
            inside[i] = ("data-in" in marks[i] or inside[page.parents[i]]) and "data-out" not in marks[i]
    return page, inside


def train(pages: DataFrame | None, *, max_pages: int = 300, templates: int = 500, max_chars: int = 50_000) -> Boosted:
    """Fit on ``templates`` built pages and at most ``max_pages`` given ones with semantic tags.

    Given pages are taken by a hash of their markup; training looks at the first ``max_chars`` characters of one, which
    bounds what the driver holds. Extraction reads whole pages.
    """
    xs, ys = [], []
    for source, _ in template_pages(templates):
        page, inside = labelled(source)
        xs.append(features(page)[1:])
        ys.append(inside[1:])
    if pages is not None:
        some = pages.where("html IS NOT NULL").select(F.substring("html", 1, max_chars).alias("html"), F.xxhash64("html").alias("at"))
        some = smallest(some, "at", max_pages).dropDuplicates(["at"])
        for row in sorted(some.collect(), key=lambda r: (r["at"], r["html"])):
            page = parse(row["html"])
            inside = truth(page)
            if inside is not None and len(inside) > 1:
                xs.append(features(page)[1:])
                ys.append(inside[1:])
    return boost(np.vstack(xs), np.concatenate(ys))


# ---------------------------------------------------------------- decoding


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """Which nodes are in: along each path the evidence adds up, and a rejected node rejects all below.

    A box of several blocks is only left out as a whole if it is surely outside; smaller nodes are
    judged with what is above them, so one unsure paragraph follows its box. Inline elements are part of the block
    they stand in.
    """
    odds = np.log(chance / (1 - chance)).tolist()
    path, keep, barred = [0.0] * len(odds), [False] * len(odds), [False] * len(odds)
    for i in range(1, len(odds)):
        up = page.parents[i]
        if page.tags[i] in INLINE and up:
            path[i], keep[i], barred[i] = path[up], keep[up], barred[up]
            continue
        path[i] = odds[i] if up == 0 else 0.5 * path[up] + 0.5 * odds[i]
        strong = page.tags[i] in OUTSIDE or bool(page.hints[i] & OUTSIDE_HINTS)
        barred[i] = barred[up] or (keep[up] and odds[i] < -1.0) or (strong and path[i] < 0)
        keep[i] = not barred[i] and path[i] > 0
    return np.array(keep)


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, of any length, are U+FFFD."""
    if "&#" in text:
        text = re.sub(r"&#([xX]?)0++(?=[0-9a-fA-F])", r"&#\1", text)
        text = re.sub(r"&#(?:[xX][0-9a-fA-F]{7,}|[0-9]{8,});?", "\ufffd", text)
    return html.unescape(text)


def text_of(page: Page, keep: np.ndarray) -> str:
    """The blocks of kept nodes, one per line."""
    blocks, now, kept = [], [], keep.tolist()
    for node, piece in [*page.pieces, (0, None)]:
        if piece is None:
            if now:
                block = SPACE.sub(" ", unescaped("".join(now))).strip()
                if block:
                    blocks.append(block)
                now = []
        elif kept[node]:
            now.append(piece)
    return "\n".join(blocks)


def texts_of(sources: list[str], model: Boosted) -> list[str]:
    """The main texts of some pages; their nodes are scored together."""
    pages = [parse(source) for source in sources]
    rows = [features(page) for page in pages]
    chances = np.split(model.scores(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    # Text without any element is the whole of its page.
    return [
        text_of(page, decode(page, chance) if {*page.tags[1:]} - {RUN} else np.ones(len(page.tags), bool))
        for page, chance in zip(pages, chances, strict=True)
    ]


def main_text(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                texts = texts_of([x or "" for x in part.column("html").to_pylist()], model)
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
