"""Main text of web pages from flat text blocks.

A page is read as a flat sequence of text blocks: block-level tags part
blocks, inline tags do not. Each block has the number of its words, its link
density (the share of its words inside links), the same two of the block
before and after it, and whether it stands inside an article or inside an
element that names itself as something else (menu, header, advert, form,
comments ...). A decision tree over these features, trained on the small
labelled table below, tells main text from the rest. The main text is the
blocks of the first kind, in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, batch_of, slices

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q "
                   "rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template textarea select option datalist iframe object svg math canvas "
                   "audio video map head title button".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_MAIN = frozenset("nav aside footer form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("div section ul ol dl li table tbody tr td article main header details figure center "
                       "aside nav footer form".split())
# Names of containers that hold something else than the page's text. Those of the first group
# stay so even around an article; those of the last say nothing inside one, which has a header of its own.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
OTHER = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs complementary consent "
                  "contentinfo cookie cookies disclaimer footer login menu menubar modal nav navbar navigation "
                  "newsletter notice notices notification outbrain pagination pager popup promo promotion related "
                  "share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription taboola "
                  "tagcloud toolbar widget widgets".split())
HEADERS = frozenset("header masthead banner search".split())
SITE = frozenset("site page global main top primary secondary bottom".split())
_HIDDEN_ATTR = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_PART = re.compile(r"[-_\d]+")


def _names(attrs: str) -> set[str]:
    """What an element calls itself: whole names, their leading words, and what follows a word for the site."""
    out = set()
    for g in _ATTR.findall(attrs):
        for name in "".join(g).lower().split():
            parts = [x for x in _PART.split(name) if x]
            out.add(name)
            if parts:
                out.add(parts[0])
                if len(parts) == 2 and parts[0] in SITE:
                    out.add(parts[1])
    return out


class _Tags:
    """Finds the ends of a page's tags from left to right; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.known: dict[int, int] = {}  # quote or bracket outside quotes -> end of the tag it stands in, or -1

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``, quoted ones passed over;
        the first one of all where no other is, -1 without any."""
        if at > self.last[">"]:
            return -1
        seen, found = [], -1
        while (m := _STOP.search(self.page, at)) is not None:
            k = m.start()
            if k in self.known:
                found = self.known[k]
                break
            seen.append(k)
            if (q := m[0]) == ">":
                found = k
                break
            at = self.page.index(q, k + 1) + 1 if k < self.last[q] else k + 1  # a last quote quotes nothing
        for k in seen:
            self.known[k] = found
        return found

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """``(start, end, name, closing, attributes)`` of the next tag or comment (no name)."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                z = page.find("-->", at + 4)
                return at, len(page) if z < 0 else z + 3, "", False, ""
            if page.startswith(("<!", "<?"), at):
                z = page.find(">", at) if at < self.last[">"] else -1
                return at, len(page) if z < 0 else z + 1, "", False, ""
            closing = page.startswith("/", at + 1)
            m = _NAME.match(page, at + 1 + closing)
            if m:
                z = self.end(m.end())
                if z < 0 and m.end() <= self.last[">"]:
                    z = page.index(">", m.end())
                if z >= 0:
                    return at, z + 1, m[0].lower(), closing, page[m.end():z]
            at += 1
        return None


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    place: int  # 1 inside an article, -1 inside something else (-2: whatever it holds), 0 neither


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; hidden elements, markup and comments give none.

    Open elements are closed by their end tag, and by the end tag of an element
    around them; text after a broken or missing tag is still read.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # name, place, hidden
    opened: Counter[str] = Counter()         # names on the stack
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split())
            in_links = len(html.unescape(" ".join(linked)).split())
            out.append(Block(text, n, min(1.0, in_links / n), max(-1, stack[-1][1]) if stack else 0))
        parts.clear()
        linked.clear()

    def text(s):
        if s and not (stack and stack[-1][2]):
            parts.append(s)
            if links:
                linked.append(s)

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    tags, at, n = _Tags(page), 0, len(page)
    while (tag := tags.next(at)) is not None:
        start, end, name, closing, attrs = tag
        text(page[at:start])
        at = end
        if not name:
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            text(" ")
        if name in VOID or (name in INLINE and not _ATTR.search(attrs) and not _HIDDEN_ATTR.search(attrs)
                            and not closing):
            if name not in INLINE:
                flush()
            continue
        if closing:
            if opened[name]:
                if name not in INLINE:
                    flush()
                    links = 0
                while pop() != name:
                    pass
            elif name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
            if name in LEFT_OPEN and stack and stack[-1][0] == name:
                pop()  # the end tag may be left out
        up_place, up_hidden = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        hidden = up_hidden or name in HIDDEN or bool(_HIDDEN_ATTR.search(attrs))
        place = _place(name, _names(attrs) if name in CONTAINERS else set(), up_place)
        if name in INLINE and place == up_place and not hidden:
            continue
        if attrs.rstrip().endswith("/") and name in ("svg", "iframe", "script", "object"):
            continue
        stack.append((name, place, hidden))
        opened[name] += 1
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else n
    text(page[at:])
    flush()
    return out


LEFT_OPEN = frozenset("p li dt dd tr td th option".split())


def _place(name: str, names: set[str], up: int) -> int:
    """Place inside an element called ``names`` that stands at the place ``up``."""
    if up == -2 or name in NOT_MAIN or names & COMMENTS:
        return -2
    if name in MAIN:
        return 1  # whatever names around it said
    if up == -1 or names & OTHER or (up < 1 and (name == "header" or names & HEADERS)):
        return -1
    return up


# Labelled blocks. Words and link density of the block, of the one before and of the one after,
# place, and whether the block is main text. Written for pages of news, manuals, shops, forums and blogs.
LABELLED = [
    # paragraphs and headings of articles, long and short
    (60, 0.0, 7, 0.0, 45, 0.0, 1, 1), (45, 0.0, 60, 0.0, 80, 0.02, 1, 1), (7, 0.0, 0, 0.0, 60, 0.0, 1, 1),
    (1, 0.0, 30, 0.0, 25, 0.0, 1, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 1), (3, 0.0, 6, 1.0, 90, 0.0, 1, 1),
    (12, 0.5, 40, 0.0, 33, 0.1, 1, 1), (5, 1.0, 40, 0.0, 52, 0.0, 1, 1), (20, 0.9, 30, 0.0, 22, 0.0, 1, 1),
    (150, 0.05, 20, 0.0, 3, 1.0, 1, 1), (4, 0.0, 3, 0.0, 2, 0.0, 1, 1), (1, 0.0, 1, 0.0, 0, 0.0, 1, 1),
    (9, 0.0, 5, 1.0, 4, 1.0, 1, 1), (25, 0.2, 2, 1.0, 40, 0.0, 1, 1),
    # lists of links inside articles: sources, contents
    (2, 1.0, 3, 1.0, 2, 1.0, 1, 1), (3, 1.0, 2, 1.0, 4, 1.0, 1, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1),
    (4, 1.0, 2, 1.0, 6, 1.0, 1, 1),
    # menus, headers, footers, sidebars, notices, adverts, forms, comments
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0), (1, 1.0, 1, 1.0, 8, 0.0, -1, 0), (8, 0.0, 1, 1.0, 7, 0.0, -1, 0),
    (40, 0.0, 50, 0.0, 35, 0.0, -1, 0), (120, 0.0, 30, 0.0, 60, 0.0, -1, 0), (10, 0.1, 55, 0.0, 0, 0.0, -1, 0),
    (3, 0.0, 2, 0.0, 3, 0.0, -1, 0), (15, 0.3, 90, 0.0, 12, 0.4, -1, 0), (25, 0.0, 6, 0.0, 6, 0.0, -1, 0),
    (70, 0.02, 2, 0.0, 65, 0.0, -1, 0), (2, 0.0, 0, 0.0, 40, 0.0, -1, 0), (6, 0.5, 100, 0.0, 2, 1.0, -1, 0),
    # pages that name nothing: text is dense and little linked, the rest is short or linked
    (55, 0.0, 40, 0.0, 62, 0.0, 0, 1), (80, 0.05, 3, 1.0, 44, 0.0, 0, 1), (30, 0.0, 70, 0.0, 2, 1.0, 0, 1),
    (18, 0.0, 45, 0.0, 60, 0.0, 0, 1), (6, 0.0, 50, 0.0, 48, 0.0, 0, 1), (8, 0.0, 2, 1.0, 70, 0.0, 0, 1),
    (35, 0.1, 6, 0.0, 40, 0.0, 0, 1), (22, 0.0, 25, 0.0, 19, 0.0, 0, 1), (3, 0.0, 45, 0.0, 50, 0.0, 0, 1),
    (100, 0.0, 0, 0.0, 0, 0.0, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 1), (28, 0.05, 0, 0.0, 3, 0.0, 0, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0), (3, 1.0, 4, 1.0, 60, 0.0, 0, 0), (4, 1.0, 50, 0.0, 3, 1.0, 0, 0),
    (3, 0.0, 1, 1.0, 2, 1.0, 0, 0), (5, 0.0, 3, 0.0, 4, 0.0, 0, 0), (2, 0.0, 2, 0.0, 0, 0.0, 0, 0),
    (12, 0.8, 6, 1.0, 10, 0.9, 0, 0), (25, 0.9, 20, 0.8, 30, 0.9, 0, 0), (6, 0.0, 5, 0.0, 0, 0.0, 0, 0),
    (4, 0.0, 2, 1.0, 0, 0.0, 0, 0), (40, 0.7, 30, 0.6, 35, 0.8, 0, 0), (9, 0.4, 4, 1.0, 3, 1.0, 0, 0),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 0), (3, 0.0, 0, 0.0, 5, 0.0, 0, 0),
]
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "place")


def train_tree(rows: list[tuple], max_depth: int = 6) -> tuple:
    """Decision tree by Gini impurity: ``(feature, limit, at most, above)`` or a class at a leaf.

    Ties go to the feature named first and the lowest limit.
    """
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows])

    def grow(keep: np.ndarray, depth: int):
        label = int(2 * y[keep].sum() >= keep.sum())
        if depth == max_depth or y[keep].min() == y[keep].max():
            return label
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[keep, f])
            for limit in (values[1:] + values[:-1]) / 2:
                low = keep & (x[:, f] <= limit)
                high = keep & ~low
                cost = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, high))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(limit), low, high)
        if best is None:
            return label
        return best[1], best[2], grow(best[3], depth + 1), grow(best[4], depth + 1)

    return grow(np.ones(len(rows), bool), 0)


def is_main(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_blocks(page: str | None, tree) -> list[str]:
    """Texts of the main blocks of a page; none for null and empty pages.

    Where the tree finds none, a page too short to tell by its blocks' lengths,
    the main blocks are those that nothing names and that are not mostly links.
    """
    found = blocks(page) if page else []
    edge = Block("", 0, 0.0, 0)
    main = [b.text for p, b, q in zip([edge, *found], found, [*found[1:], edge])
            if is_main(tree, (b.words, b.link_density, p.words, p.link_density, q.words, q.link_density, b.place))]
    return main or [b.text for b in found if b.place >= 0 and b.link_density < 0.5]


def extract_main(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` of every row of ``pages(page_id, url, html)``.

    Main blocks are joined by an empty line. A null or empty html, and a page
    without main text, give the empty text. Repeated rows stay repeated; null
    ids and urls are handed on, other columns ignored whatever their names; no
    rows give no rows. A page is read whole, however long.
    """
    tree = train_tree(labelled or LABELLED)

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "html")):
            parts = [main_blocks(h, tree) for h in b.column("html").to_pylist()]
            texts = ["\n\n".join(p) for p in parts]
            yield batch_of(page_id=b.column("page_id"), url=b.column("url"), text=pa.array(texts, pa.string()),
                           n_chars=np.fromiter(map(len, texts), np.int64, len(texts)),
                           n_blocks=np.fromiter(map(len, parts), np.int64, len(parts)))

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op1_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
