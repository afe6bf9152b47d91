"""Main text of web pages by boosted trees over DOM nodes.

A page is read into a tree of elements. Every element gets features: its tag, words of
its class, id and role attributes by hash, depth, share of link text, density of text in
its subtree, and figures of its parent and siblings. Gradient-boosted trees give the
probability that an element is kept, given that its parent is; nothing is kept inside a
dropped element. Decoding is hierarchical: of all choices without such contradictions it
takes the most probable one for the whole tree, so an ancestor's choice weighs the best
choices of all that lies in it.

The text of the kept elements is decoded, white space inside a block becomes one space,
and blocks are joined in page order by one space.

The trees are trained on at most ``SAMPLE`` pages (smallest seeded digest), as they are and
with further menus, sidebars, notices, forms and reader comments put in, made of words of
the pages. Elements are labelled by what HTML itself says: sectioning tags and the
attribute words in ``BOILERPLATE``.

Defined results: a null or empty page gives an empty text; text outside any element
belongs to the root. Open elements end with their parent, stray end tags are skipped,
scripts, styles and comments are never text; a tag that is never closed is text. Very long,
broken or deep pages are read whole, in time that grows with their length. An element whose
odds are even is kept. Repeated rows get equal texts, and a repeated page_id gives the
sample one row. An empty table trains nothing and gives no rows. Other columns pass through.
"""

from __future__ import annotations

import html
import random
import re
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import digest

SAMPLE = 250
SEED = 42
TREES, DEPTH, RATE, BINS = 60, 4, 0.3, 32
_ATTRIBUTES = 64  # hashed attribute words

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript template svg iframe".split())
_NEVER = frozenset("script style noscript template svg iframe head title meta link textarea select option button".split())
_INLINE = frozenset(
    "a abbr b bdi bdo cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr del".split()
)
_CLOSES = {  # an open element of the values ends where one of the keys begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_SCOPE = frozenset("html body article section div ul ol dl table td th main aside nav footer header form blockquote".split())
_TAGS = (
    "html body head title article main section div p ul ol li a nav header footer aside form table tr td span b i h1 h2 h3 h4 "
    "blockquote pre figure figcaption script style button input label br img"
).split()
_TAG_NUMBER = {t: i + 1 for i, t in enumerate(_TAGS)}
# Words of class, id and role attributes that mark what is not the article; they label training pages.
BOILERPLATE = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs sidebar side "
    "widget related footer header masthead cookie cookies consent notice popup modal overlay newsletter subscribe signup login "
    "form search share social comments comment replies discussion disqus toolbar pagination pager complementary contentinfo".split()
)
_BOILER_TAGS = frozenset("nav footer aside form header".split())

_TOKEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/<>\"']*))")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_BLANKS = re.compile(r"\s+")


class Page(NamedTuple):
    """Elements in page order, and the stretches of text between tags."""

    tags: list[str]
    parents: list[int]  # -1 for the root
    words: list[list[str]]  # of the attributes
    texts: list[tuple[int, str]]  # (element, raw text), in page order
    breaks: list[int]  # texts before each block edge


class _Ends:
    """Where tags end: the next ``>`` outside quotes, each stretch of the page searched once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.begin, self.mark = 0, -1  # the first mark at or after ``begin``
        self.after: dict[int, int] = {}  # opening quote -> the tag's end, -1 if there is none

    def _next(self, at: int) -> int:
        if not self.begin <= at <= self.mark:
            found = _MARK.search(self.page, at)
            self.begin, self.mark = at, found.start() if found else len(self.page)
        return self.mark

    def find(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``, -1 if it is never closed."""
        page, passed = self.page, []
        while True:
            mark = self._next(at)
            if mark == len(page):
                end = -1
                break
            if page[mark] == ">":
                end = mark
                break
            if mark in self.after:
                end = self.after[mark]
                break
            passed.append(mark)
            close = page.find(page[mark], mark + 1)
            if close < 0:
                end = -1
                break
            at = close + 1
        self.after.update(dict.fromkeys(passed, end))
        return end


def read(page: str | None) -> Page:
    """Read a page in time that grows with its length; element 0 is a root that HTML does not name."""
    tags, parents, words = ["root"], [-1], [[]]
    texts: list[tuple[int, str]] = []
    breaks: list[int] = []
    stack = [0]
    places: dict[str, list[int]] = {}  # depths of the open elements by name
    page = page or ""
    ends = _Ends(page)
    at, size = 0, len(page)
    last = page.rfind(">")

    def close(upto: int) -> None:
        while len(stack) > upto:
            name = tags[stack.pop()]
            places[name].pop()
            if name not in _INLINE:
                breaks.append(len(texts))

    def opened(names, stop) -> int | None:
        top = lambda some: max((places[n][-1] for n in some if places.get(n)), default=0)
        depth = top(names)
        return depth if depth and depth > top(stop) else None

    begin = 0  # of the text not yet stored
    while at < size:
        match = _TOKEN.search(page, at)
        if not match:
            break
        start, name = match.start(), match.group(2)
        if name is not None:
            end = ends.find(match.end()) if start < last else -1
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = size if end < 0 else end + 2
        else:
            end = page.find(">", match.end()) if start < last else -1
        if end < 0:  # never closed: its sign is text
            at = match.end()
            continue
        if start > begin:
            texts.append((stack[-1], page[begin:start]))
        at = begin = end + 1
        if name is None:
            continue
        name = name.lower()
        if match.group(1):
            depth = opened((name,), ())
            if depth is not None:
                close(depth)
            elif name in ("p", "br"):
                breaks.append(len(texts))
            continue
        if name in _ENDS_P and (depth := opened(("p",), _SCOPE)) is not None:
            close(depth)
        if name in _CLOSES and (depth := opened(_CLOSES[name], ("ul", "ol", "dl", "table", "select"))) is not None:
            close(depth)
        if name not in _INLINE:
            breaks.append(len(texts))
        rest = page[match.end() : end]
        found = []
        if rest and "=" in rest:
            for m in _ATTRIBUTE.finditer(rest):
                found += _WORDS.findall((m.group(1) or m.group(2) or m.group(3) or "").lower())
        number = len(tags)
        tags.append(name)
        parents.append(stack[-1])
        words.append(found)
        if name in _VOID or rest.endswith("/") and name not in _SCOPE and name != "p":
            continue
        if name in _RAW:
            close_tag = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            texts.append((number, page[at : close_tag.start() if close_tag else size]))
            breaks.append(len(texts))
            at = begin = close_tag.end() if close_tag else size
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(number)
    if begin < size:
        texts.append((stack[-1], page[begin:]))
    return Page(tags, parents, words, texts, breaks)


# ---- features ------------------------------------------------------------------

_NUMERIC = 16
# The nearest of these around an element, 0 if there is none.
_SECTIONS = {t: i + 1 for i, t in enumerate("article main section nav header footer aside form".split())}
_WORDS_AT = _NUMERIC + len(_TAGS) + 1
_SECTION_AT = _WORDS_AT + _ATTRIBUTES
WIDTH = _SECTION_AT + len(_SECTIONS) + 1


def features(page: Page) -> np.ndarray:
    """Features of each element, as small whole numbers."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    own_text, own_marks = [0.0] * n, [0.0] * n
    for element, text in page.texts:
        if tags[element] not in _NEVER and not text.isspace():
            own_text[element] += len(text)
            own_marks[element] += text.count(".") + text.count(",")
    level, kid_count, at, linked, around = [0] * n, [0] * n, [0] * n, [False] * n, [0] * n
    for i in range(1, n):
        p = parents[i]
        level[i] = level[p] + 1
        linked[i] = linked[p] or tags[i] == "a"
        around[i] = _SECTIONS.get(tags[p], around[p])
        at[i] = kid_count[p]
        kid_count[p] += 1
    is_linked = np.array(linked)
    own = np.array(own_text)
    sums = np.stack([
        np.ones(n), own, np.where(is_linked, own, 0.0), np.array(own_marks), [t == "p" for t in tags], [t == "a" for t in tags],
        [t in ("input", "button", "select", "textarea") for t in tags],
    ], axis=1).astype(float)
    for i in range(n - 1, 0, -1):  # subtrees
        sums[parents[i]] += sums[i]
    size, text, links, marks, paragraphs, anchors, inputs = sums.T
    depth, kids, place, parents = np.array(level), np.array(kid_count), np.array(at), np.array(parents)
    up = np.maximum(parents, 0)
    total = max(text[0], 1.0)
    log = lambda x: np.minimum(np.log2(1 + x) * 2, BINS - 1)
    part = lambda a, b: np.minimum(a / np.maximum(b, 1e-9), 1.0) * (BINS - 1)
    numeric = [
        np.minimum(depth, BINS - 1), log(size), log(text), log(own), part(links, text), part(text, total),
        log(text / size), part(marks * 20, text), np.minimum(kids, BINS - 1), log(paragraphs), log(anchors), np.minimum(inputs, 8),
        part(text, text[up]), part(links[up], text[up]), part(place + 1, kids[up]), log(paragraphs[up]),
    ]
    x = np.zeros((n, WIDTH), dtype=np.uint8)
    for c, values in enumerate(numeric):
        x[:, c] = values.astype(np.uint8)
    rows = np.arange(n)
    x[rows, [_NUMERIC + _TAG_NUMBER.get(t, 0) for t in page.tags]] = 1
    x[rows, [_SECTION_AT + s for s in around]] = 1
    for i, words in enumerate(page.words):
        for word in words:
            x[i, _WORDS_AT + crc32(word.encode()) % _ATTRIBUTES] = 1
    return x


# ---- boosted trees ---------------------------------------------------------------


class Trees(NamedTuple):
    """Constant, and per tree the split column, threshold (go right above) and leaf values."""

    constant: float
    columns: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with whole trees of fixed depth."""
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    constant = float(np.log(rate / (1 - rate)))
    z = np.full(len(y), constant)
    columns = np.zeros((trees, 2**depth - 1), dtype=np.int64)
    cuts = np.full((trees, 2**depth - 1), BINS, dtype=np.int64)
    leaves = np.zeros((trees, 2**depth))
    width = x.shape[1]
    flat = x.astype(np.int64) + np.arange(width) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(2**level):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                bins = flat[rows].ravel()
                gs = np.bincount(bins, np.repeat(g[rows], width), minlength=width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(bins, np.repeat(h[rows], width), minlength=width * BINS).reshape(width, BINS).cumsum(1)
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (all_g - gs) ** 2 / (all_h - hs + ridge) - all_g**2 / (all_h + ridge)
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    columns[t, first + k], cuts[t, first + k] = divmod(best, BINS)
            node = node * 2 + (x[np.arange(len(x)), columns[t, first + node]] > cuts[t, first + node])
        top = np.bincount(node, g, minlength=2**depth)
        leaves[t] = RATE * top / (np.bincount(node, h, minlength=2**depth) + ridge)
        z += leaves[t][node]
    return Trees(constant, columns, cuts, leaves)


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    z, rows = np.full(len(x), trees.constant), np.arange(len(x))
    depth = trees.leaves.shape[1].bit_length() - 1
    for columns, cuts, leaves in zip(trees.columns, trees.cuts, trees.leaves):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            at = 2**level - 1 + node
            node = node * 2 + (x[rows, columns[at]] > cuts[at])
        z += leaves[node]
    return z


# ---- decoding --------------------------------------------------------------------


def keep(parents: list[int], odds: np.ndarray) -> list[bool]:
    """The most probable elements to keep, never one without its parent.

    ``odds`` are log-odds of keeping an element whose parent is kept. The root stays.
    """
    n = len(parents)
    stay, go = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    for i in range(n - 1, 0, -1):  # a kept element carries the best of its children
        stay[parents[i]] += max(stay[i], go[i])
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parents[i]] and stay[i] >= go[i]
    return kept


def main_text(page: Page, kept: list[bool]) -> str:
    """Text of the kept elements, blocks joined by one space."""
    parts: list[str] = []
    edges = page.breaks
    at = 0
    for number, (element, text) in enumerate(page.texts):
        edge = False
        while at < len(edges) and edges[at] <= number:
            edge, at = True, at + 1
        if edge:
            parts.append(" ")
        if kept[element] and page.tags[element] not in _NEVER:
            parts.append(html.unescape(text))
    return _BLANKS.sub(" ", "".join(parts)).strip()


def extract(trees: Trees, pages: list[str | None]) -> list[str]:
    """Main texts of a batch of pages."""
    out: list[str] = []
    for i in range(0, len(pages), 64):
        read_pages = [read(p) for p in pages[i : i + 64]]
        made = [features(p) for p in read_pages]
        odds = log_odds(trees, np.concatenate(made))
        at = 0
        for page, x in zip(read_pages, made):
            out.append(main_text(page, keep(page.parents, odds[at : at + len(x)])))
            at += len(x)
    return out


# ---- training --------------------------------------------------------------------


def labels(page: Page) -> np.ndarray:
    """1 for elements that are neither boilerplate by name nor inside of such."""
    out = np.ones(len(page.tags))
    for i in range(1, len(page.tags)):
        tag, parent = page.tags[i], page.parents[i]
        named = tag in _BOILER_TAGS or bool(BOILERPLATE.intersection(page.words[i]))
        if tag == "header" and page.tags[parent] in ("article", "main") and not page.words[i]:
            named = False
        out[i] = 0 if not out[parent] or named or tag in _NEVER else 1
    return out


def examples(page: Page) -> np.ndarray:
    """Features and label of the elements whose parent is kept: what the trees decide."""
    y = labels(page)
    decided = y[np.maximum(page.parents, 0)] > 0
    return np.column_stack([features(page), y.astype(np.uint8)])[decided]


def varied(page: str, draw: random.Random) -> str:
    """The page with more kinds of boilerplate around and inside its article."""
    words = re.findall(r"[^\W\d_]{2,}", re.sub(r"<[^>]*>", " ", page))[:400] or ["text"]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    links = lambda n: "".join(f'<li><a href="/{k}">{say(draw.randint(1, 4))}</a></li>' for k in range(n))
    name = lambda *kinds: draw.choice(("class", "id")) + f'="{draw.choice(kinds)}"'
    kinds = (
        lambda: f'<header><a href="/">{say(3)}</a><p>{say(8)}</p></header>',
        lambda: f'<div {name("header", "site-header", "masthead")}><span>{say(4)}</span></div>',
        lambda: f"<aside><h3>{say(2)}</h3><ul>{links(4)}</ul><p>{say(20)}</p></aside>",
        lambda: f'<div {name("sidebar", "side widget", "related")}><h3>{say(3)}</h3><ul>{links(5)}</ul></div>',
        lambda: f'<div {name("menu", "navbar", "breadcrumb", "nav")}><ul>{links(4)}</ul></div>',
        lambda: f'<div {name("cookie-notice", "consent banner", "notice", "popup")}><p>{say(draw.randint(5, 30))}</p><button>{say(1)}</button></div>',
        lambda: f'<div {name("ad", "ads", "advert", "sponsored promo", "advertisement")}><p>{say(draw.randint(4, 25))}</p></div>',
        lambda: f'<form action="/s"><label>{say(2)}</label><input name="q"><button>{say(1)}</button></form>',
        lambda: f'<div {name("newsletter", "subscribe", "login", "search-form")}><p>{say(9)}</p><input></div>',
        lambda: f'<div {name("share", "social toolbar")}><a href="#">{say(1)}</a> <a href="#">{say(1)}</a></div>',
        lambda: f'<footer><p>{say(12)}</p></footer>',
        lambda: f'<div {name("footer", "site-footer")}><p>{say(10)}</p></div>',
        lambda: f'<{draw.choice(("section", "div"))} {name("comments", "comment-list", "discussion")}>' + "".join(
            f'<div class="comment"><b>{say(1)}</b><p>{say(draw.randint(5, 60))}</p></div>' for _ in range(draw.randint(1, 5))
        ) + "</section>",
    )
    open_at, close_at = page.find("<article"), page.rfind("</article>")
    if open_at < 0 or close_at < open_at:
        return page
    inner_at = page.find(">", open_at) + 1
    inside = page[inner_at:close_at]
    if draw.random() < 0.4:  # a short article, beside which the rest looks large
        inside = f"<p>{say(draw.randint(1, 12))}</p>" * draw.randint(1, 2)
    if draw.random() < 0.5:  # an article by another name
        start, end = draw.choice((
            ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"),
            ('<section class="post">', "</section>"), ("<div>", "</div>"), ("<main><article>", "</article></main>"),
            ('<div role="main">', "</div>"), ('<div class="entry-content">', "</div>"),
        ))
    else:
        start, end = page[open_at:inner_at], "</article>"
    if draw.random() < 0.4:  # tables, lists and quotes belong to the article
        inside += draw.choice((
            f"<ul><li>{say(6)}</li><li>{say(5)}</li></ul>", f"<blockquote><p>{say(14)}</p></blockquote>",
            f"<table><tr><td>{say(2)}</td><td>{say(2)}</td></tr></table>", f"<h2>{say(4)}</h2><p>{say(30)}</p>",
            f'<p>{say(8)} <a href="/x">{say(3)}</a> {say(9)}</p>', f"<figure><figcaption>{say(7)}</figcaption></figure>",
        ))
    if draw.random() < 0.3:
        inside += draw.choice(kinds)()
    some = lambda: "".join(draw.choice(kinds)() for _ in range(draw.randint(0, 3)))
    return page[:open_at] + some() + start + inside + end + some() + page[close_at + len("</article>") :]


def learn(pages: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Trees:
    """Train on at most ``sample`` pages of ``pages`` (page_id, html); the driver gets features only."""
    chosen = pages.select("page_id").distinct().withColumn("_order", digest(seed, "page_id")).orderBy("_order", "page_id").limit(sample)
    chosen = F.broadcast(chosen.select(F.col("page_id").alias("_id")).distinct())  # at most ``sample`` rows
    texts = pages.select("page_id", "html").join(chosen, F.col("page_id") == F.col("_id"))
    texts = texts.groupBy("page_id").agg(F.min("html").alias("html"))  # an id may have any number of rows

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, text in zip(batch["page_id"], batch["html"]):
                draw = random.Random(seed * 1_000_003 + int(page_id))
                for variant in (text or "", varied(text or "", draw), varied(text or "", draw)):
                    rows.append((int(page_id), examples(read(variant)).tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "x"])

    got = sorted((r["page_id"], r["x"]) for r in texts.mapInPandas(run, "page_id long, x binary").collect())
    if not got:
        return boost(np.zeros((0, WIDTH), dtype=np.uint8), np.zeros(0), trees=0)
    rows = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, WIDTH + 1) for _, x in got])
    return boost(rows[:, :-1], rows[:, -1].astype(float))


def texts(page: Column, trees: Trees) -> Column:
    """Main text of a page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series(extract(trees, list(pages)), dtype=object)

    return run(page)
