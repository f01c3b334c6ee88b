"""Main text of web pages from the events of the standard library's streaming parser.

A page becomes lines, one for each block of text, with the number of characters and tags in each. The ratio of the two
is smoothed by a Gaussian over neighbouring lines and the lines are split into two clusters at a threshold; the lines
above it are content. From the page's root the way goes down to the element that holds this content: an article or the
element with headings or long lines of its own. That region is the result without the parts that are marked as menus,
headers, footers, sidebars, notices, adverts, forms or comments; its short lines stay. Where no element encloses the
content, the region ends with the first and last long line, and with the headings before the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
SIGMA, RADIUS = 1.0, 2

# fixed values: what elements and their classes, ids and roles mean
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol search section table ul".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("address caption dd dt figcaption hr legend li p pre summary tbody td tfoot th thead tr".split())
SILENT = frozenset("applet audio button canvas datalist iframe math noscript object script select style svg template textarea title video".split())
CLOSED_BY_ITS_LIKE = frozenset("dd dt li p td th tr".split())
MARKED = frozenset("aside dialog footer form header menu nav search".split())
MARKED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
MARKED_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer "
    "menu modal nav navbar navigation newsletter notice notices pagination popup promo promos recommended related replies respond share sharing "
    "sidebar signup skyscraper social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
MARKED_NAMES = MARKED_WORDS | frozenset("header masthead page-header reply site-header site-info top-header topbar".split())
NOT_MEANT = frozenset("has is no non not with without".split())

_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none")


def marked_by_name(tag: str, attributes: dict[str, str | None]) -> bool:
    """Do class, id, role or visibility say that an element is no part of an article?"""
    if "hidden" in attributes or _HIDDEN.search((attributes.get("style") or "").lower()):
        return True
    if (attributes.get("role") or "").strip().lower() in MARKED_ROLES:
        return True
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split():
        if name in MARKED_NAMES:
            return True
        words = _WORDS.findall(name)
        if tag not in ("article", "main", "body", "html") and words and words[0] not in NOT_MEANT and not MARKED_WORDS.isdisjoint(words):
            return True
    return False


class Page(HTMLParser):
    """Lines and containers of a page, filled while its text is fed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, container, is it a heading
        self.tags_of, self.parent, self.marked = ["html"], [0], [False]
        self.open = [0]
        self.pieces: list[str] = []
        self.tags = 0
        self.heading = False
        self.silent, self.depth = "", 0

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1], self.heading))
        self.pieces.clear()
        self.tags, self.heading = 0, False

    def push(self, tag: str, attributes: dict[str, str | None]) -> None:
        marked = tag in MARKED or marked_by_name(tag, attributes)
        if tag in CONTAINERS or marked:
            self.tags_of.append(tag)
            self.parent.append(self.open[-1])
            self.marked.append(marked)
            self.open.append(len(self.parent) - 1)

    def pop(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.tags_of[self.open[k]] == tag:
                del self.open[k:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            self.depth += tag == self.silent
            return
        if tag in SILENT:
            self.silent, self.depth = tag, 1
        elif tag in BLOCKS:
            self.end_line()
            top = self.tags_of[self.open[-1]]
            if top == "p" or top == tag and tag in CLOSED_BY_ITS_LIKE:
                self.open.pop()
            self.heading = tag in HEADINGS
            if tag != "hr" and tag not in ("html", "body"):
                self.push(tag, dict(attrs))
        elif tag == "br":
            self.pieces.append(" ")
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.depth -= tag == self.silent
            if not self.depth:
                self.silent = ""
            return
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Conditional comments and CDATA sections are skipped like other declarations."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def parsed(html: str) -> Page:
    page = Page()
    for at in range(0, len(html), CHUNK):
        page.feed(html[at:at + CHUNK])
    page.close()
    page.end_line()
    return page


def smoothed(values: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(values, kernel / kernel.sum())[RADIUS:RADIUS + len(values)]


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of two clusters in one dimension."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100 if low < high else 0):
        upper = values >= (low + high) / 2
        means = float(values[~upper].mean()), float(values[upper].mean())
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The blocks of the main text, one a line; empty for a page without any."""
    page = parsed(html or "")
    if not page.lines:
        return ""
    count, parent = len(page.parent), page.parent
    sizes = np.array([len(line[0]) for line in page.lines])
    where = [line[2] for line in page.lines]

    def up(own: list[float]) -> list[float]:
        total = list(own)
        for k in range(count - 1, 0, -1):  # a container's number is larger than its parent's
            total[parent[k]] += total[k]
        return total

    chars, articles = [0.0] * count, [0.0] * count
    for size, k in zip(sizes.tolist(), where):
        chars[k] += size
    chars = up(chars)
    for k in range(1, count):
        articles[parent[k]] += page.tags_of[k] in ("article", "main")
    articles = up(articles)
    # a mark on an element around most of the page and an article in it is a style's name, not its meaning
    out = [False] * count
    for k in range(1, count):
        out[k] = out[parent[k]] or page.marked[k] and not (articles[k] and 2 * chars[k] > chars[0])

    ratio = np.array([0.0 if out[k] else size / max(1, tags) for (_, tags, k, _), size in zip(page.lines, sizes.tolist())])
    open_lines = np.array([not out[k] for k in where])
    if not open_lines.any():
        return ""
    around = np.log1p(smoothed(ratio))
    limit = threshold(around[open_lines])
    content, long_lines = open_lines & (around >= limit), open_lines & (np.log1p(ratio) >= limit)

    mass, own_lines = [0.0] * count, [False] * count
    for size, k, good, is_long, line in zip(sizes.tolist(), where, content.tolist(), long_lines.tolist(), page.lines):
        if not out[k]:
            mass[k] += size * good
            own_lines[k] = own_lines[k] or is_long or line[3]
    mass = up(mass)
    children: list[list[int]] = [[] for _ in range(count)]
    for k in range(1, count):
        if not out[k]:
            children[parent[k]].append(k)
    region = 0
    while page.tags_of[region] != "article" and children[region]:
        best = max(children[region], key=mass.__getitem__)
        is_article = page.tags_of[best] in ("article", "main")
        if not (mass[best] > 0.5 * mass[region] if is_article else not own_lines[region] and mass[best] >= 0.8 * mass[region]):
            break
        region = best

    inside = [False] * count
    inside[region] = True
    for k in range(region + 1, count):
        inside[k] = inside[parent[k]] and not out[k]
    chosen = [i for i, k in enumerate(where) if inside[k]]
    good = [n for n, i in enumerate(chosen) if long_lines[i]]
    if not region and good:
        first = good[0]
        while first and page.lines[chosen[first - 1]][3]:
            first -= 1
        chosen = chosen[first:good[-1] + 1]
    return "\n".join(page.lines[i][0] for i in chosen)


def extract_text(pages: DataFrame, *, keep: list[str], html: str = "html") -> DataFrame:
    """The columns `keep` of pages with text and n_chars (code points); columns of these names are replaced.

    A null or empty page and one without text give an empty text. White space is what str.split splits at, a line break element
    included. Pages are judged one by one, whole, in the order of their parts; repeated rows stay repeated; an empty table stays empty.
    """
    kept = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*[pages[c] for c in kept], pages[html].alias("_op_html"))
    schema = rows.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [main_text(value.as_py()) for value in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
