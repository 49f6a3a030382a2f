"""Main text of web pages: boosted trees judge the DOM's block nodes, a decoding over the tree keeps them consistent.

A page is read into a flat tree of its block elements, and of those inline elements whose attributes speak of something
else than the article; reading takes time in proportion to the page, however broken it is. Each node has features of its subtree (density of text, links
and tags), of its attributes, its depth and its siblings. The trees give the probability that a node is main text.
The decoding then picks for every node one of three states: all of it is main text, none of it is, or its children
differ; of all labellings without contradiction between a node and what stands below, the likeliest wins. An inline
element that isn't main text leaves its block's text, which stays one block.
The classifier is fitted on pages that this module makes up, in many layouts, so that it needs no labelled pages.
"""

from __future__ import annotations

import bisect
import html as references
import itertools
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import tuned

#: Pages made up for the classifier, and the seed of their layouts.
MADE_PAGES, SEED = 500, 7
#: What it costs a node, in log probability, that its children differ.
MIXED = 0.4

# Element names of HTML.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head svg math iframe object select button textarea option title canvas audio video datalist".split())
# An element that ends open ones of the same sort, unless one of the others stands between.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
_HOLDS_P = ("td", "th", "table", "li")

#: Kinds of words in class, id, role and element names.
KINDS = {
    "article": "article post entry story content contents text body main maincontent page blogpost longform prose",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar skip toc",
    "header": "header masthead banner topbar branding logo tagline site-header hero",
    "footer": "footer colophon copyright legal bottom imprint credits site-footer",
    "aside": "aside sidebar side widget widgets complementary rail secondary related recommended popular trending teaser promo more",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored dfp adsense taboola outbrain promotion affiliate commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner-notice message warning disclaimer paywall privacy",
    "comment": "comment comments commentlist disqus respond reply replies discussion reader-comments thread reviews",
    "form": "form subscribe newsletter signup login search contact field input register",
    "share": "share sharing social follow facebook twitter like likes tags tag byline meta author date rating print tools",
}
_KIND_OF = {w: k for k, words in enumerate(KINDS.values()) for w in words.split()}
_TAG_KIND = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "article": "article", "main": "article", "dialog": "notice"}
_TAGS = ("p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "td", "table", "blockquote", "pre", "figcaption", "dd", "body", "form")
_NK = len(KINDS)

#: Inline elements of these kinds are nodes.
_JUDGED = sum(1 << list(KINDS).index(k) for k in ("nav", "header", "footer", "aside", "ad", "notice", "comment", "form", "share"))

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)")
_PLAIN = re.compile(r"[^<>\"']*")
_ATTR = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
_HEAD_END = re.compile(r"</head\b|<body\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select", "button", "math", "object", "canvas", "audio", "video", "datalist")}


class Page:
    """A page's nodes in document order: parallel lists, a parent's index below its children's."""

    __slots__ = ("depth", "images", "inline", "inputs", "kinds", "linked", "mark", "parent", "segments", "tag", "tags")

    def __init__(self):
        self.tag, self.parent, self.depth, self.kinds, self.mark, self.inline = [], [], [], [], [], []
        self.tags, self.linked, self.inputs, self.images = [], [], [], []
        self.segments: list[list[tuple[int, str]]] = []  # blocks of text: pieces, each with its node

    def add(self, tag: str, parent: int, kinds: int, mark: str | None, inline: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kinds.append(kinds)
        self.mark.append(mark if mark is not None else self.mark[parent] if parent >= 0 else None)
        self.inline.append(inline)
        for x in (self.tags, self.linked, self.inputs, self.images):
            x.append(0)
        return len(self.tag) - 1

    def texts(self) -> list[str]:
        """All blocks of text."""
        return [t for t in (_joined(s) for s in self.segments) if t]


def _joined(pieces: list[tuple[int, str]]) -> str:
    return _SPACE.sub(" ", "".join(t for _, t in pieces)).strip()


def _kinds(tag: str, attrs: str) -> tuple[int, str | None]:
    """The kinds of words in an element's name and attributes, as bits; the mark of a made-up page."""
    bits, mark = 0, None
    if tag in _TAG_KIND:
        bits |= 1 << _KIND_OF[_TAG_KIND[tag]]
    elif "-" in tag:
        bits |= _kinds_of(tag)
    if attrs:
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "data-y":
                mark = value
                continue
            bits |= _kinds_of(value)
    return bits, mark


def _kinds_of(names: str) -> int:
    bits = 0
    for token in names.split():
        for w in {token.lower(), *(x.lower() for x in _WORD.findall(token))}:
            if (k := _KIND_OF.get(w)) is not None:
                bits |= 1 << k
    return bits


class _Ends:
    """Where tags end, found in time in proportion to the text: a place from which a tag was seen not to end is not tried again."""

    def __init__(self, text: str):
        self.text, self.dead, self.next_gt, self.next_lt = text, set(), -1, -1
        self.last = {q: text.rfind(q) for q in "\"'"}

    def gt(self, at: int) -> int:
        """The next > from a place on, else the end."""
        if self.next_gt < at:
            found = self.text.find(">", at)
            self.next_gt = found if found >= 0 else len(self.text)
        return self.next_gt

    def lt(self, at: int) -> int:
        if self.next_lt < at:
            found = self.text.find("<", at)
            self.next_lt = found if found >= 0 else len(self.text)
        return self.next_lt

    def of_tag(self, at: int) -> tuple[int, int]:
        """Where the attributes from a place on end, and where text goes on. Quoted values hold anything; a tag that isn't closed ends before the next one."""
        text, seen, k = self.text, [], at
        while k not in self.dead:
            seen.append(k)
            k = _PLAIN.match(text, k).end()
            if k == len(text) or text[k] == "<":
                break
            if text[k] == ">":
                return k, k + 1
            k = text.find(text[k], k + 1) + 1 if k < self.last[text[k]] else k + 1  # a quote without an end is none
        self.dead.update(seen)
        gt, lt = self.gt(at), self.lt(at)
        return (gt, min(gt + 1, len(text))) if gt <= lt else (lt, lt)


class _Open:
    """Open elements, with the places of each name, so that none is searched for."""

    def __init__(self):
        self.items: list[tuple[str, int, bool]] = []  # name, node or -1, whether a block
        self.at: dict[str, list[int]] = {}
        self.nodes: list[int] = []
        self.blocks: list[int] = []

    def push(self, tag: str, node: int, block: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.items))
        if block:
            self.blocks.append(len(self.items))
        if node >= 0:
            self.nodes.append(node)
        self.items.append((tag, node, block))

    def pop_to(self, depth: int) -> bool:
        """Closes what is open from a depth on; whether a block was."""
        ended = False
        while len(self.items) > depth:
            tag, node, block = self.items.pop()
            if tag:
                self.at[tag].pop()
            if block:
                self.blocks.pop()
                ended = True
            if node >= 0:
                self.nodes.pop()
        return ended

    def last(self, *tags: str) -> int:
        """The depth of the latest open element of some names, else -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def first_after(self, depth: int, tags: tuple[str, ...]) -> int:
        """The depth of the first open element of some names beyond a depth, else -1."""
        found = [x[k] for t in tags if (x := self.at.get(t)) and (k := bisect.bisect_right(x, depth)) < len(x)]
        return min(found, default=-1)


def parse(text: str) -> Page:
    """Reads HTML, well-formed or not: unclosed and stray tags, comments, raw text elements, character references."""
    page, opened, tags = Page(), _Open(), _Ends(text)
    opened.push("html", page.add("html", -1, 0, None), True)
    pieces: list[tuple[int, str]] = []
    unended: set[str] = set()  # elements whose end isn't there any more
    at, end = 0, len(text)

    def flush() -> None:
        nonlocal pieces
        if pieces:
            if any(not t.isspace() for _, t in pieces):
                page.segments.append(pieces)
            pieces = []

    def say(raw: str) -> None:
        if raw:
            node = opened.nodes[-1]
            pieces.append((node, references.unescape(raw) if "&" in raw else raw))
            if opened.at.get("a"):
                page.linked[node] += len(raw.strip())

    def pop_to(depth: int) -> None:
        if opened.pop_to(depth):
            flush()

    while at < end:
        lt = tags.lt(at)
        say(text[at:lt])
        at = lt
        if at == end:
            break
        name = _NAME.match(text, at)
        if not name:
            if text.startswith("<!--", at):
                stop = text.find("-->", at + 4)
                at = stop + 3 if stop >= 0 else end
            elif text.startswith(("<!", "<?", "</"), at):
                at = min(tags.gt(at) + 1, end)
            else:
                say("<")
                at += 1
            continue
        stop, at = tags.of_tag(name.end())
        tag, attrs = name[2].lower(), text[name.end() : stop]
        if name[1]:
            if tag in BLOCK:
                flush()
            depth = opened.last(tag)
            if depth >= 0 and tag not in ("html", "body"):
                if opened.items[depth][2] or depth > opened.blocks[-1]:
                    pop_to(depth)
                else:  # an inline element that a block overlaps ends for itself; the block goes on
                    opened.at[tag].pop()
                    opened.items[depth] = ("", *opened.items[depth][1:])
            continue
        page.tags[opened.nodes[-1]] += 1
        if tag in _RAW_END or tag == "head":
            if tag in ("button", "select", "textarea"):
                page.inputs[opened.nodes[-1]] += 1
            if tag in unended:
                found = None
            elif tag == "head":
                found = _HEAD_END.search(text, at)
            else:
                found = None if attrs.rstrip().endswith("/") else _RAW_END[tag].search(text, at)
                if attrs.rstrip().endswith("/"):
                    continue
            if not found:
                unended.add(tag)
                at = end if tag in ("script", "style", "textarea", "title", "iframe", "math", "canvas", "audio", "video", "datalist") else at
            else:
                at = found.start() if tag == "head" and found[0].lower().startswith("<body") else tags.of_tag(found.end())[1]
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((opened.nodes[-1], " "))
                if tag == "hr":
                    flush()
            page.inputs[opened.nodes[-1]] += tag == "input"
            page.images[opened.nodes[-1]] += tag == "img"
            continue
        if tag in UNSEEN:
            continue
        closed = attrs.rstrip().endswith("/")
        if tag in BLOCK or ("-" in tag and not closed and opened.last("p") <= opened.last(*_HOLDS_P)):  # an element of the page's own, outside a paragraph
            flush()
            if tag in ("html", "body") and (tag == "html" or opened.at.get(tag)):
                continue
            depth = opened.last("p")
            if depth > opened.last(*_HOLDS_P):  # a block ends an open paragraph, if no cell stands between
                pop_to(depth)
            if tag in _CLOSES:
                same, bound = _CLOSES[tag]
                found = opened.first_after(opened.last(*bound), same)
                if found > 0:
                    pop_to(found)
            bits, mark = _kinds(tag, attrs)
            opened.push(tag, page.add(tag, opened.nodes[-1], bits, mark), True)
        elif not closed:
            bits, mark = _kinds(tag, attrs) if attrs or "-" in tag else (0, None)
            judged = bits & _JUDGED or mark is not None
            opened.push(tag, page.add(tag, opened.nodes[-1], bits, mark, True) if judged else -1, False)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """One row for each node: of its subtree, its attributes and its ancestors', its place and its siblings."""
    n = len(page.tag)
    chars, segs, stops, upper = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    first, last = np.full(n, np.inf), np.zeros(n)
    at = 0
    for pieces in page.segments:
        for i, run in itertools.groupby(pieces, key=lambda p: p[0]):
            if s := _joined(list(run)):
                chars[i] += len(s)
                segs[i] += 1
                stops[i] += s.count(". ") + s.count(", ") + (s[-1] in ".!?")
                first[i] = min(first[i], at)
                at += len(s)
                last[i] = at
    parent = page.parent
    own = chars.copy()
    tags, linked, inputs, images = (np.array(x, np.float64) for x in (page.tags, page.linked, page.inputs, page.images))
    paras, items, heads = (np.array([t in g for t in page.tag], np.float64) for g in (("p", "blockquote", "pre"), ("li", "dd", "dt"), ("h1", "h2", "h3", "h4", "h5", "h6")))
    top = np.array([t == "h1" for t in page.tag], np.float64)
    children, same = np.zeros(n), Counter()
    index = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        index[i] = children[p]
        children[p] += 1
        same[p, page.tag[i]] += 1
    sums = (chars, segs, stops, tags, linked, inputs, images, paras, items, heads, top)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for v in sums:
            v[p] += v[i]
        first[p], last[p] = min(first[p], first[i]), max(last[p], last[i])
    total = max(1.0, chars[0])
    up = np.array(parent)
    up[0] = 0
    above = np.zeros(n, np.int64)
    for i in range(1, n):
        above[i] = above[parent[i]] | page.kinds[parent[i]]
    kinds = np.array(page.kinds, np.int64)
    before, after = np.zeros(n), np.zeros(n)
    latest: dict[int, int] = {}
    for i in range(1, n):
        if (j := latest.get(parent[i])) is not None:
            before[i], after[j] = chars[j], chars[i]
        latest[parent[i]] = i
    c1 = np.maximum(chars, 1)
    columns = [
        np.log1p(chars), chars / total, linked / c1, np.minimum(5, tags / c1 * 100), np.array(page.depth, np.float64), np.log1p(children), index / np.maximum(1, children[up] - 1), np.log1p(children[up]),
        np.array([same[parent[i], page.tag[i]] for i in range(n)], np.float64), chars / np.maximum(1, chars[up]), np.where(np.isinf(first), 1, first / total), last / total, np.log1p(paras), np.log1p(items), stops / c1 * 100,
        chars / np.maximum(1, segs), inputs, heads, top, images, np.log1p(before), np.log1p(after), own / c1, linked[up] / np.maximum(1, chars[up]), np.log1p(paras[up]),
    ]
    columns += [(kinds >> k & 1).astype(np.float64) for k in range(_NK)]
    columns += [(above >> k & 1).astype(np.float64) for k in range(_NK)]
    columns += [np.array([t == g for t in page.tag], np.float64) for g in _TAGS]
    columns.append(np.array(page.inline, np.float64))
    return np.stack(columns, axis=1)


def _speaking(page: Page) -> set[int]:
    """Nodes with text of their own."""
    return {i for pieces in page.segments for i, t in pieces if not t.isspace()}


def decoded(page: Page, p: np.ndarray) -> list[bool]:
    """For each node whether its own text is main text, in the likeliest labelling of the tree without contradictions."""
    n = len(page.tag)
    yes, no = np.log(np.clip(p, 1e-6, 1)).tolist(), np.log(np.clip(1 - p, 1e-6, 1)).tolist()
    speaks = [False] * n
    for i in _speaking(page):
        speaks[i] = True
    silent = not page.segments
    whole, none, mixed = [0.0] * n, [0.0] * n, [0.0] * n
    filled = list(speaks)
    for i in range(n - 1, -1, -1):
        if filled[i] and not silent:
            whole[i] += yes[i]
            none[i] += no[i]
            mixed[i] += -MIXED + (max(yes[i], no[i]) if speaks[i] else 0)
            if i:
                q = page.parent[i]
                filled[q] = True
                whole[q] += whole[i]
                none[q] += none[i]
                mixed[q] += max(whole[i], none[i], mixed[i])
    state, out = [0] * n, [False] * n  # 1 all, -1 none, 0 by itself
    for i in range(n):
        above = state[page.parent[i]] if i else 0
        if above:
            state[i] = above
        elif filled[i]:
            best = max(whole[i], none[i], mixed[i])
            state[i] = 1 if best == whole[i] else -1 if best == none[i] else 0
        out[i] = state[i] > 0 or (state[i] == 0 and yes[i] > no[i])
    return out


def text_of(page: Page, p: np.ndarray) -> str:
    main = decoded(page, p)
    kept = (_joined([(i, t) for i, t in pieces if main[i]]) for pieces in page.segments)
    return "\n\n".join(t for t in kept if t)


class _Maker:
    """Makes up pages; elements carry data-y: 1 for main text, 0 for the rest."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r, out = self.r, []
        for _ in range(n):
            out.append("".join(r.choice(("ka", "lo", "re", "ti", "mun", "es", "an", "or", "vi", "st", "u")) for _ in range(r.randint(1, 4))) + (r.choice((",", ".", ".", "!", "?")) if r.random() < 0.13 else ""))
        return " ".join(out).capitalize()

    def sentence(self, lo: int, hi: int) -> str:
        return self.words(self.r.randint(lo, hi)).rstrip(",.!?") + "."

    def name(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.2:  # a name that says nothing
            return r.choice(("", f' class="c{r.randint(10, 999)}"', f' id="x{r.randint(10, 999)}" class="row"', ' class="box inner"'))
        w = r.choice(KINDS[kind].split())
        w = r.choice((w, w, f"site-{w}", f"{w}-{r.choice(('box', 'wrap', 'area', 'list', 'inner'))}", f"the{w.capitalize()}"))
        return r.choice((f' class="{w}"', f' id="{w}"', f' class="{w} box"', f" class='{w}'"))

    def links(self, n: int) -> str:
        r, wrap = self.r, self.r.random()
        each = [f'<a href="/{i}">{self.words(r.randint(1, 4))}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>" if wrap < 0.7 else r.choice((" | ", " ", "<br>")).join(each)

    def inline(self, kind: str, main: bool) -> str:
        """An element within a line of text."""
        r, tag = self.r, self.r.choice(("span", "span", "a", "em", "b", "small", f"x-{self.r.choice(KINDS[kind].split())}"))
        return f'<{tag} class="{r.choice(KINDS[kind].split())}" data-y="{int(main)}">{self.sentence(1, 12)}</{tag}>'

    def other(self, kind: str, open_tag: str, inner: str) -> str:
        if self.r.random() < 0.06:  # an element of the page's own
            open_tag = f"{self.r.choice(('my', 'app', 'x', 'site'))}-{self.r.choice(KINDS[kind].split())}"
        return f'<{open_tag}{self.name(kind)} data-y="0">{inner}</{open_tag}>'

    def rest(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.other("nav", r.choice(("nav", "nav", "div", "ul", "div")), self.links(r.randint(3, 9)))
        if kind == "header":
            return self.other("header", r.choice(("header", "header", "div")), r.choice((f"<h1>{self.words(2)}</h1>", f'<a href="/">{self.words(2)}</a>', f"<div>{self.words(3)}</div>", "")) + r.choice((f"<p>{self.words(r.randint(3, 9))}</p>", self.links(4), self.words(r.randint(2, 14)))))
        if kind == "footer":
            return self.other("footer", r.choice(("footer", "footer", "div")), r.choice((f"&copy; {self.words(3)} &middot; {self.sentence(4, 20)}", f"<p>{self.sentence(5, 25)}</p>" + self.links(3), self.links(5), f"<p>{self.sentence(4, 12)}</p><p>{self.sentence(4, 30)}</p>")))
        if kind == "aside":
            return self.other("aside", r.choice(("aside", "aside", "div", "section")), f"<h{r.randint(2, 4)}>{self.words(2)}</h3>" * r.randint(0, 1) + r.choice((self.links(r.randint(3, 8)), f"<p>{self.sentence(5, 40)}</p>", "".join(f"<p><a href=#>{self.words(5)}</a></p><p>{self.sentence(5, 15)}</p>" for _ in range(3)), f"<p>{self.sentence(8, 40)}</p>" + self.links(3))))
        if kind == "ad":
            return self.other("ad", r.choice(("div", "div", "aside", "section", "p")), r.choice((self.sentence(3, 25), f"<a href=#>{self.words(6)}</a>", f"<div>{self.sentence(4, 14)}</div><a href=#>{self.words(2)}</a>")))
        if kind == "notice":
            return self.other("notice", r.choice(("div", "div", "section", "dialog", "p")), r.choice((self.sentence(6, 30), f"<p>{self.sentence(6, 40)}</p><button>{self.words(1)}</button>", f"<p>{self.sentence(6, 25)} <a href=#>{self.words(2)}</a></p>")))
        if kind == "form":
            return self.other("form", r.choice(("form", "form", "div")), f"<label>{self.words(2)}</label><input name=a>" + r.choice((f"<p>{self.sentence(4, 20)}</p>", "", self.sentence(3, 15))) + r.choice(("<button>ok</button>", "<input type=submit>", "")))
        if kind == "share":
            return self.other("share", r.choice(("div", "ul", "p")), r.choice((self.links(4), self.words(4), f"<span>{self.words(2)}</span> <time>{self.words(2)}</time>")))
        each = "".join(r.choice((f"<li{self.name('comment')}><b>{self.words(1)}</b><p>{self.sentence(4, 60)}</p></li>", f"<div{self.name('comment')}><p>{self.words(2)}</p><p>{self.sentence(4, 80)}</p></div>", f"<p>{self.words(1)}: {self.sentence(3, 50)}</p>")) for _ in range(r.randint(1, 8)))
        return self.other("comment", r.choice(("div", "section", "ol", "div")), f"<h3>{self.words(2)}</h3>" * r.randint(0, 1) + each)

    def block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.72:
            s = self.sentence(2, r.choice((8, 40, 120)))
            if r.random() < 0.25:
                w = s.split(" ")
                s = f"{w[0]} <a href=#>{' '.join(w[1:3])}</a> {' '.join(w[3:])}"
            if r.random() < 0.1:  # something else in the line, or a part of it whose class sounds like something else
                kind = r.choice(("ad", "ad", "ad", "notice", "comment", "form", "share"))
                s = r.choice((f"{s} {self.inline(kind, False)}", f"{self.inline(kind, False)} {s}")) if r.random() < 0.6 else f"{self.sentence(2, 8)} {self.inline(r.choice(('header', 'footer', 'nav', 'aside')), True)} {s}"
            return r.choice((f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}", f"<p><b>{s}<br>", f"<div>{s}</div>", f"<p><span>{s}</span></p>"))
        if k < 0.82:
            return f"<h{(h := r.randint(2, 4))}>{self.words(r.randint(2, 7))}</h{h}>"
        if k < 0.90:
            return r.choice(("<ul>", "<ol>")) + "".join(f"<li>{self.sentence(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        return r.choice((f"<blockquote><p>{self.sentence(5, 40)}</p></blockquote>", f"<pre>{self.words(20)}</pre>", f"<table><tr><td>{self.words(3)}</td><td>{self.words(4)}</td></tr><tr><td>{self.words(3)}</td><td>{self.words(2)}</td></tr></table>", f"<figure><img src=a><figcaption>{self.sentence(3, 14)}</figcaption></figure>", f"<dl><dt>{self.words(2)}</dt><dd>{self.sentence(3, 20)}</dd></dl>"))

    def page(self) -> str:
        r = self.r
        some = lambda kind, p: self.rest(kind) if r.random() < p else ""
        n = r.choice((1, 2, 3, 5, 8, 13, 30))
        body = [self.block() for _ in range(n)]
        if r.random() < 0.3:
            body = ["<p>" + self.sentence(1, 10) + "</p>"] * (n < 2) + body
        for kind, p in (("ad", 0.25), ("share", 0.2), ("form", 0.15), ("aside", 0.15), ("notice", 0.1)):
            if r.random() < p:
                body.insert(r.randint(0, len(body)), self.rest(kind))
        title = f"<h1>{self.words(r.randint(2, 9))}</h1>" if r.random() < 0.85 else ""
        inner = title + some("share", 0.2) + "".join(body) + some("share", 0.1) + some("comment", 0.08)
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td", "article", "div", "my-article"))
        main = f'<{tag}{self.name("article") if r.random() < 0.6 else ""} data-y="1">{inner}</{tag}>'
        main = f"<table><tr>{some('aside', 0.5)}{main}</tr></table>" if tag == "td" else main
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 3))):
            w = r.choice(("div", "main", "section", "div"))
            main = f"<{w}{r.choice(('', self.name('article'), ' class=wrap', ' id=container'))}>{some('nav', 0.15)}{some('aside', 0.15)}{main}{some('aside', 0.3)}{some('comment', 0.15)}</{w}>"
        head = f"<head><title>{self.words(3)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        before = [some("notice", 0.25), some("header", 0.4), some("nav", 0.7), some("ad", 0.35), some("form", 0.15), some("aside", 0.12)]
        if r.random() < 0.3:
            r.shuffle(before)
        after = [some("comment", 0.3), some("aside", 0.3), some("nav", 0.15), some("ad", 0.2), some("form", 0.2), some("notice", 0.15)]
        if r.random() < 0.3:
            r.shuffle(after)
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- c -->{main}{''.join(after)}{some('footer', 0.8)}</body></html>"


class Extractor(NamedTuple):
    trees: boosting.Boosted

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main texts of pages, judged together; of null and empty pages, and such without main text, empty ones."""
        parsed = [parse(p or "") for p in pages]
        x = [features(p) for p in parsed]
        prob = self.trees.probability(np.concatenate(x)) if x else np.zeros(0)
        ends = np.cumsum([len(f) for f in x], dtype=np.int64)
        return [text_of(p, prob[e - len(f) : e]) for p, f, e in zip(parsed, x, ends)]


def labelled(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of a made-up page are wholly main text or wholly not, and which of the two."""
    n = len(page.tag)
    yes, no = np.zeros(n, bool), np.zeros(n, bool)
    for i in _speaking(page):
        (yes if page.mark[i] == "1" else no)[i] = True
    for i in range(n - 1, 0, -1):
        yes[page.parent[i]] |= yes[i]
        no[page.parent[i]] |= no[i]
    pure = yes ^ no
    return np.flatnonzero(pure), yes[pure]


def fit_extractor(pages: int = MADE_PAGES, seed: int = SEED) -> Extractor:
    """Trees fitted on the nodes of so many made-up pages; the same for the same seed. It reads no table."""
    maker, x, y = _Maker(seed), [], []
    for _ in range(pages):
        page = parse(maker.page())
        at, label = labelled(page)
        x.append(features(page)[at])
        y.append(label)
    return Extractor(boosting.fit(np.concatenate(x), np.concatenate(y).astype(np.float64)))


def extract_pages(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    text has the main text's blocks in page order, joined by two newlines; white space within a block is one space. It
    is empty for null or empty html and for pages without main text. Null ids and urls stay null, repeated rows stay.
    """
    spark = tuned(pages)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extractor.texts(b.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
