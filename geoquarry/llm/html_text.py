"""Main text of HTML pages by minimum cut.

A page becomes its text blocks and the elements that hold them. The cost of calling a block content or boilerplate
is its log-odds from two sources: what the elements around it say (tags, and words of class, id and role, which add
up and can outweigh each other), and a logistic regression on the block's text alone, trained on a bounded sample
of pages that mark their article and their furniture by tags. Positive odds are capacities from the source, negative
ones capacities to the sink; neighbouring blocks, and blocks and elements next to each other in the document tree,
are tied by smoothness edges of about the weight of a doubtful block. The maximum flow separates content from the
rest at the least total cost: a doubtful block goes with the blocks around it, a certain one does not.

Class words are hints and no verdicts: the last telling word of a name counts most ("comment-list" is about comments,
"register-entry" an entry), and some words (adverts, comments, cookies) count wherever they stand in a name.

Blocks have character references decoded and white space made single; kept blocks are joined by two line feeds.
Null and empty pages, and pages without content, give the empty text. Rows may repeat, ids may be null and extra
columns are ignored. Nothing is cut short: every page is read whole.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.llm.common import table

#: Pages that training may use, chosen by hash order, and blocks of each of them, evenly spaced.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 200
#: Log-odds of elements: hidden ones, page furniture, article containers; of words in names: chrome, hints of it, body.
HIDDEN, FURNITURE, ARTICLE, CHROME, HINT, BODY_NAME = 8.0, 6.0, 4.0, 4.5, 1.0, 2.0
#: Bounds of an element's odds with those around it, and of what a block's text may say.
MOST, TEXT_MOST = 8.0, 3.0
#: Capacities of the edges between neighbouring blocks, blocks and their elements, elements and theirs.
BESIDE, INSIDE, NESTED = 1.5, 1.0, 0.5
#: Weights of a text's features before any page is seen; training moves them.
PRIOR = np.array([-2.0, 0.4, 0.1, -3.0, 1.0, 1.2, 0.5, -1.0, -3.0])

# Elements of HTML by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video textarea title head".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select option label fieldset legend datalist".split())
BODY_TAGS = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words that mark page furniture wherever they stand in a name, and words that do so at its end.
CLEAR_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer discussion dropdown gdpr modal navbar newsletter pager pagination paywall popup promo promoted promotion "
    "recommended related replies respond sharing signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
CHROME_WORDS = CLEAR_WORDS | frozenset(
    "alert aside banner bar byline copyright dialog feedback foot footer form header hidden login masthead menu menus meta nav navigation notice notices notification overlay recommend register reply search share sidebar sidebars signin skip "
    "survey tags teaser toc topbar tracking".split()
)
BODY_WORDS = frozenset("article body content entry main post story text".split())
#: Words that say nothing about what an element holds.
PLAIN_WORDS = frozenset("area block bottom box center col column container group inner item items left list outer panel right row section top wrap wrapper".split())
STATE_WORDS = frozenset("has with without no is not".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Element:
    tag: str
    parent: Element | None
    odds: float  # what this element and those around it say
    depth: int
    in_body: bool
    number: int = -1


@dataclass
class Block:
    text: str
    element: Element
    link_chars: int
    heading: bool


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0


def _own_odds(tag: str, attrs: str, parent: Element | None) -> tuple[float, bool]:
    """Log-odds that an element adds, and whether it begins an article body."""
    in_body = parent is not None and parent.in_body
    names: list[str] = []
    if attrs and tag not in ("html", "body"):
        for m in _NAMES.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key == "hidden" and m[0].lower() == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -HIDDEN, in_body
            if key in ("class", "id", "role"):
                names.extend(value.split())
    odds = sum(_name_odds(n, in_body) for n in dict.fromkeys(names))
    if tag in CHROME_TAGS or tag == "header" and not in_body:
        odds -= FURNITURE
    elif tag in BODY_TAGS:
        odds, in_body = odds + ARTICLE, True
    return odds, in_body


@lru_cache(maxsize=4096)
def _name_odds(name: str, in_body: bool) -> float:
    """What one class, id or role says: its last telling word, and hints of the words before it; an article's header is its own."""
    parts = [w.lower() for w in _WORD.findall(name)]
    parts = [w for w in parts if w not in PLAIN_WORDS and not w.isdigit() and not (in_body and w == "header")]
    if not parts or parts[0] in STATE_WORDS:
        return 0.0
    if any(w in CLEAR_WORDS for w in parts):
        return -CHROME
    odds = sum((w in BODY_WORDS) * BODY_NAME / 2 - (w in CHROME_WORDS) * HINT for w in parts[:-1])
    return odds + (parts[-1] in BODY_WORDS) * BODY_NAME - (parts[-1] in CHROME_WORDS) * CHROME


def _nested(own: float, around: float) -> float:
    """Odds of an element: furniture in an article is furniture, an article in furniture is half of one."""
    if own < 0:
        around = min(around, 0.0)
    elif around < 0:
        own /= 2
    return max(-MOST, min(MOST, own + around if own < 0 or around < 0 else max(own, around)))


def blocks(page: str | None) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and the elements that hold some."""
    if not page:
        return [], []
    root = Element("", None, 0.0, 0, False)
    top, out, own, in_link, at = root, [], _Open(), False, 0
    held: list[Element] = []

    def text(piece: str) -> None:
        if piece:
            own.parts.append(piece)
            if in_link:
                own.link_chars += len(piece.strip())

    def close() -> None:
        nonlocal own
        if own.parts:
            joined = " ".join(html.unescape("".join(own.parts)).split())
            if joined:
                if top.number < 0:
                    top.number = len(held)
                    held.append(top)
                out.append(Block(joined, top, own.link_chars, top.tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
            own = _Open()

    while True:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        m = _TAG.match(page, begin) or _LOOSE.match(page, begin)
        if m is None:  # a lone sign
            text(page[at : begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        at = m.end()
        if m.re is _TAG and m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag == "br":
                own.parts.append(" ")
            continue
        close()
        in_link = False
        if m[1]:
            node = top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in SKIPPED and tag != "head" or tag in VOID:
            continue
        if top.tag == "p":
            top = top.parent
        if tag in CLOSES and top.tag in CLOSES[tag]:
            top = top.parent
            if tag == "tr" and top.tag == "tr":
                top = top.parent
        odds, in_body = _own_odds(tag, m[3], top)
        top = Element(tag, top, _nested(odds, top.odds), top.depth + 1, in_body)
    close()
    return out, held


def features(b: Block) -> list[float]:
    """What the text alone says about a block."""
    n, words = len(b.text), b.text.count(" ") + 1
    marks = sum(b.text.count(c) for c in ".,;:!?")
    return [1.0, np.log1p(n), np.log1p(words), min(1.0, b.link_chars / n), min(1.0, marks / words), float(b.text[-1] in ".!?…\"”"), float(b.heading), sum(map(str.isdigit, b.text)) / n, float("©" in b.text)]


def _marked(b: Block) -> int | None:
    """1 in an element that its tag marks as the article, 0 in one that its tag marks as furniture; names do not count."""
    e = b.element
    while e is not None:
        if e.tag in BODY_TAGS:
            return 1
        if e.tag in CHROME_TAGS:
            return 0
        e = e.parent
    return None


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR, both classes weighing alike; PRIOR if one is missing."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - (w - PRIOR)
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut; ``edges`` are undirected. Dinic's algorithm."""
    n = len(source)
    to: list[int] = []
    left: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]
    s, t = n, n + 1

    def add(a: int, b: int, there: float, back: float) -> None:
        near[a].append(len(to))
        to.append(b)
        left.append(there)
        near[b].append(len(to))
        to.append(a)
        left.append(back)

    for v in range(n):
        straight = min(source[v], sink[v])
        if source[v] > straight:
            add(s, v, source[v] - straight, 0.0)
        if sink[v] > straight:
            add(v, t, sink[v] - straight, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in near[v]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        step, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if left[e] <= 1e-9)
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while step[v] < len(near[v]):
                e = near[v][step[v]]
                if left[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                step[v] += 1
            else:
                if v == s:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(near[v][step[v]])
            v = to[path[-1]]


def network(found: list[Block], held: list[Element], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of the nodes (blocks, then elements, which have none of their own) and the edges between them."""
    n = len(found)
    said = np.clip(np.array([features(b) for b in found]) @ weights, -TEXT_MOST, TEXT_MOST)
    odds = [float(b.element.odds + s) for b, s in zip(found, said, strict=True)]
    edges = [(k, k + 1, BESIDE * _shared(found[k].element, found[k + 1].element)) for k in range(n - 1)]
    number = {id(e): n + i for i, e in enumerate(held)}
    extra = list(held)
    for k, b in enumerate(found):
        edges.append((k, number[id(b.element)], INSIDE))
    for e in extra:  # grows by the elements above
        if e.parent is not None and e.parent.depth:
            if id(e.parent) not in number:
                number[id(e.parent)] = n + len(extra)
                extra.append(e.parent)
            edges.append((number[id(e)], number[id(e.parent)], NESTED))
    return odds + [0.0] * len(extra), edges


def content(found: list[Block], held: list[Element], weights: np.ndarray) -> list[bool]:
    """Whether each block is on the source side of the minimum cut."""
    odds, edges = network(found, held, weights)
    return min_cut([max(o, 0.0) for o in odds], [max(-o, 0.0) for o in odds], edges)[: len(found)]


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text of a page."""
    found, held = blocks(page)
    return "\n\n".join(b.text for b, k in zip(found, content(found, held, weights), strict=True) if k) if found else ""


def _shared(a: Element, b: Element) -> float:
    """Proximity in the document tree: twice the depth of the common element over both depths."""
    total = a.depth + b.depth
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return 2 * a.depth / total if total else 1.0


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("html"):
            own = [(y, b) for b in blocks(x.as_py())[0] if (y := _marked(b)) is not None]
            rows = [(y, features(b)) for y, b in own[:: -(-len(own) // SAMPLE_BLOCKS) or 1]]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.list_(pa.float64()))], ["y", "x"])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the text classifier, from at most ``sample_pages`` pages."""
    chosen = pages.where("html is not null").select("html").orderBy(F.md5("html"), "html").limit(sample_pages)
    rows = chosen.mapInArrow(_sample, "y long, x array<double>").collect()
    return train(np.array([r.x for r in rows]).reshape(-1, len(PRIOR)), np.array([r.y for r in rows]))


def _extractor(weights: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [extract(x.as_py(), weights) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extractor(weights), "page_id long, url string, text string")


def op2_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
