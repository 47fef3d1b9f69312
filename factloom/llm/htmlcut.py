"""Main text of web pages by minimum cut.

A page becomes a row of blocks. A logistic classifier gives each block the cost of calling it content
and that of calling it boilerplate; these are the capacities to the sink and from the source.
Neighbours in page order and blocks of one container are tied by smoothness edges, the stronger the
deeper their common container. The maximum flow's cut is the labelling of least total cost. What scripts,
styles, templates and the head hold is no block at all.

The classifier is fitted on a bounded sample of pages (``SAMPLE``): where a page names its parts
(article, main; nav, footer, aside, form ...), these are the labels. Each such block also counts
a second time with its container's marks hidden, so that pages without such marks are told by shape.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, small_batches

#: Pages that the classifier is fitted on, at most so many whatever the table, and shapes of blocks of each, chosen by a hash.
SAMPLE, SHAPES = 600, 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>|[^<]++|<",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)

#: Elements whose text is never page text, that never close, and that do not part blocks.
_SKIP = frozenset("script style template noscript title textarea select option svg math iframe object canvas audio video head datalist".split())
_RAW = frozenset("script style title textarea noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# marks of a container, inherited by what it holds
NAV, HEADER, FOOTER, ASIDE, FORM, HINT, COMMENT, MAIN, GOOD, LINK, HIDDEN = (1 << k for k in range(11))
_BAD = NAV | HEADER | FOOTER | ASIDE | FORM | HINT | COMMENT | HIDDEN
_TAG_MARK = {"nav": NAV, "menu": NAV, "header": HEADER, "footer": FOOTER, "aside": ASIDE, "form": FORM, "button": FORM, "fieldset": FORM, "dialog": HINT, "article": MAIN, "main": MAIN, "a": LINK}
_ROLE_MARK = {"navigation": NAV, "menu": NAV, "menubar": NAV, "banner": HEADER, "contentinfo": FOOTER, "complementary": ASIDE, "search": FORM, "form": FORM, "alert": HINT, "dialog": HINT, "alertdialog": HINT, "main": MAIN, "article": MAIN}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NOT_BEFORE, _NOT_AFTER = frozenset("no non without hide".split()), frozenset("free less".split())
_HINTS = {w: HINT for w in "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar widget breadcrumb breadcrumbs pagination pager toolbar tags tagcloud disclaimer copyright outbrain taboola paywall skip".split()}
_HINTS |= {w: COMMENT for w in "comment comments disqus respond replies".split()} | {w: NAV for w in "nav navbar navigation menu".split()} | {w: FOOTER for w in "footer foot".split()}
_HINTS |= {w: HEADER for w in "masthead topbar siteheader".split()} | {w: ASIDE for w in "aside rail".split()} | {w: FORM for w in "form login search".split()}
_HINTS |= {w: GOOD for w in "article content post entry story main body text".split()}


class Block:
    """One run of text between block-level tags: its text, marks, container and link share."""

    __slots__ = ("container", "depth", "linked", "marks", "tag", "text")

    def __init__(self, text: str, linked: int, marks: int, container: tuple[int, ...], tag: str):
        self.text, self.linked, self.marks, self.container, self.tag = text, linked, marks, container, tag


def _own_marks(tag: str, attrs: str, bare: bool) -> int:
    marks = _TAG_MARK.get(tag, 0)
    if tag == "a" and not _HREF.search(attrs):
        marks = 0  # an anchor, not a link
    if attrs and not attrs.isspace():
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), values[0] or values[1] or values[2]
            if name == "role":
                marks |= _ROLE_MARK.get(value.strip().lower(), 0)
            elif name == "hidden":
                marks |= HIDDEN
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    marks |= HIDDEN
            elif name in ("class", "id") and not bare:
                for name_ in value.split():
                    words = [w.lower() for w in _WORD.findall(name_)]
                    for k, w in enumerate(words):  # "ad-free" and "no-ads" say that there are none
                        if not (words[k + 1 : k + 2] and words[k + 1] in _NOT_AFTER or k and words[k - 1] in _NOT_BEFORE):
                            marks |= _HINTS.get(w, 0)
    if marks & (HINT | COMMENT | NAV | FOOTER | ASIDE | FORM):
        marks &= ~GOOD
    return marks


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order; broken nesting is read as far as it goes, nothing is cut off."""
    out: list[Block] = []
    if not page:
        return out
    # open elements: (tag, marks, skipped, number); a container is named by its last numbers
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked, at, number, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                k = len(stack) - 1
                while k and stack[k][0] in _INLINE:
                    k -= 1
                own = tuple(x[3] for x in stack[max(0, k - 3) : k])
                out.append(Block(text, linked, stack[k][1] & ~LINK, own, stack[k][0]))
            pieces.clear()
        linked = 0

    def close(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw[0] == "<" and len(raw) > 1 and not raw.startswith("<![CDATA["):
                continue
            if not stack[-1][2]:
                text = entities.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                if stack[-1][1] & LINK:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if not inline:
            flush()
        if m[1]:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if not inline or all(x[0] in _INLINE for x in stack[k:]):
                    close(k)
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P and opened.get("p"):
            k = len(stack) - 1
            while stack[k][0] in _INLINE:
                k -= 1
            if stack[k][0] == "p":
                close(k)
        if tag in _CLOSED_BY:
            k = len(stack) - 1
            while stack[k][0] in _INLINE or stack[k][0] == "p":
                k -= 1
            if stack[k][0] in _CLOSED_BY[tag]:
                close(k)
        if tag == "body" and opened.get("head"):
            k = next(k for k in range(len(stack)) if stack[k][0] == "head")
            close(k)
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue  # HTML closes no other element so; and a value without quotes may end in a slash
        up = stack[-1]
        number += 1
        stack.append((tag, up[1] | _own_marks(tag, m[3], tag in ("body", "html")), up[2] or tag in _SKIP, number))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.start() if stop else end
    flush()
    return out


# -- the classifier -------------------------------------------------------------------------------

_TAGS = ("p", "h", "li", "td", "div")


def shape(b: Block, place: float) -> list[float]:
    """Features of a block: its container's marks, then what its own text looks like."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
    tag = "h" if re.fullmatch("h[1-6]", b.tag) else b.tag
    return [
        *(1.0 if b.marks & k else 0.0 for k in (NAV, HEADER, FOOTER, ASIDE, FORM, HINT, COMMENT, MAIN, GOOD, HIDDEN)),
        math.log1p(words) / 4, min(1.0, b.linked / n), min(1.0, 8 * stops / n), 1.0 if b.text[-1] in ".!?\"'" else 0.0, abs(place - 0.5) * 2,
        *(1.0 if tag == t else 0.0 for t in _TAGS), 1.0,
    ]


_MARKS = 10
#: Ties of neighbours, for each container they share, and of blocks of one container; the most a block can weigh, and characters that weigh in full.
NEIGHBOURS, CONTAINERS, SAME_CONTAINER, MOST, SURE = 0.15, 0.25, 0.4, 6.0, 40
#: Weights to start from: they hold where a sample shows no labels.
_START = np.array([-4, -3, -4, -3, -4, -4, -5, 3.0, 1.5, -5, 1.6, -4, 0.5, 0.8, -0.4, 0.4, 0.4, -0.6, -0.2, -0.2, -0.9])


def fit(rows: np.ndarray, labels: np.ndarray, *, rounds: int = 80) -> np.ndarray:
    """Logistic regression, drawn towards the start weights."""
    if not len(rows) or labels.min() == labels.max():
        return _START.copy()
    hidden = rows.copy()
    hidden[:, :_MARKS] = 0
    x, y = np.vstack([rows, hidden]), np.append(labels, labels)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = _START.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ (share * (p - y)) + 0.02 * (w - _START))
    return w


# -- minimum cut ----------------------------------------------------------------------------------


def min_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    ``gain[i]`` is how much less node i costs on the source's side than on the other; a tie costs its
    weight if its ends part. Blocking flows over shortest paths; ends when the sink is out of reach.
    """
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        near[a].append(len(to)), near[b].append(len(to) + 1)
        to.extend((b, a)), room.extend((forth, back))

    for i, g in enumerate(gain):
        if g > 0:
            edge(s, i, g, 0.0)
        elif g < 0:
            edge(i, t, -g, 0.0)
    for a, b, w in ties:
        if w > 0:
            edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                low = min(room[e] for e in path)
                for e in path:
                    room[e] -= low
                    room[e ^ 1] += low
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nth[a] < len(near[a]):
                e = near[a][nth[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nth[a] += 1
            if nth[a] < len(near[a]):
                path.append(near[a][nth[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nth[a] += 1
            else:
                break


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours, the more so the deeper their common container, and the next block of the same container."""
    ties = []
    seen: dict[tuple[int, ...], int] = {}
    for k, b in enumerate(blocks):
        if k:
            shared = len(set(b.container) & set(blocks[k - 1].container))
            ties.append((k - 1, k, NEIGHBOURS + CONTAINERS * shared))
        if b.container in seen and seen[b.container] != k - 1:
            ties.append((seen[b.container], k, SAME_CONTAINER))
        seen[b.container] = k
    return ties


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The page's content blocks, joined by one space; empty where there is none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    last = max(1, len(blocks) - 1)
    shapes = np.array([shape(b, k / last) for k, b in enumerate(blocks)])
    # what a container is called holds for any block of it, but a short block tells little about itself
    sure = np.minimum(1.0, np.array([len(b.text) for b in blocks]) / SURE) ** 0.5
    score = shapes[:, :_MARKS] @ weights[:_MARKS] + sure * (shapes[:, _MARKS:] @ weights[_MARKS:])
    gain = np.clip(score, -MOST, MOST).tolist()
    keep = min_cut(gain, ties_of(blocks))
    return " ".join(b.text for b, content in zip(blocks, keep, strict=True) if content)


# -- the operator ---------------------------------------------------------------------------------


def learn(pages: DataFrame, *, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the blocks of a bounded sample of pages that name their parts."""
    known = pages.where("html IS NOT NULL").select("page_id", "html")
    total = known.agg(F.approx_count_distinct(F.xxhash64("page_id", "html")).alias("n")).first().n
    some = hashed_sample(known, ["page_id", "html"], sample, total=total, label="page sample")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                blocks = blocks_of(page.as_py())
                last = max(1, len(blocks) - 1)
                # shapes that repeat within a page count once
                found = {(*np.round(shape(b, k / last), 2).tolist(), 1.0 if b.marks & MAIN else 0.0) for k, b in enumerate(blocks) if b.marks & (_BAD | MAIN) and not (b.marks & MAIN and b.marks & _BAD)}
                x = sorted((np.array(row, np.float32).tobytes() for row in found), key=lambda row: (zlib.crc32(row), row))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(x[:SHAPES])], pa.binary())], ["x"])

    got = some.select("html").mapInArrow(rows, "x binary").toArrow().column(0).to_pylist()
    x = np.frombuffer(b"".join(sorted(got)), np.float32).reshape(-1, len(_START) + 1).astype(np.float64)
    return fit(x[:, :-1], x[:, -1])


def extract(spark: SparkSession, pages: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without content: empty text, 0 characters. Null page_id or url is kept.
    Repeated rows: each its own row. Long pages are read to their end. Extra columns are not read.
    """
    small_batches(spark)
    weights = learn(pages, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(page.as_py(), weights) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
