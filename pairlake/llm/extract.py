"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; blocks of a page become lines. A line knows its
text, its tags, whether it lies in a part of the page that is not content (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts), and its container. The ratio of
text to tags of each line (0 in such parts) is smoothed by a Gaussian, and lines above a
share of the ratios' deviation form the content cluster.

Some marks of such parts also stand on wrappers of whole pages: a form around everything, `widget`,
`header` or `modal` in a class. When most of the running text that the ratios select, these
parts included, lies under such marks, the ratios overrule them: the mark over most of that text
is taken for a wrapper, and so on until most of the text is free. Elements and names that only ever
mark other parts (menus, comments, scripts, ...) are never opened.

The cluster selects regions, not lines, so that short paragraphs inside the content stay:
the articles or main elements that hold lines of the cluster, or, on a page without them, the
innermost container that holds most of the cluster's text. The main text is every line of
the regions outside excluded parts, in page order.

The work is linear in the page, however deep its elements: an element knows its parent's number, sums
go from children to parents, and the open elements of a tag are found by their places.

Defined results: null, empty and tagless pages give their plain text or the empty text; broken
markup is read as the parser's events come; unclosed elements end with their container;
rows are extracted each on their own, repeated or not; an empty table gives no rows;
only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.common import bounded_batches

#: Width of the smoothing kernel and share of the deviation that makes a line content.
SIGMA = 1.0
CUT = 0.5
#: Share of the cluster's text that a region holds on pages without article or main.
MOST = 0.8
#: Characters of running text under a mark before it can be a wrapper; less is a form, box or notice.
RUNNING = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
#: Elements that are never content.
EXCLUDED = frozenset(
    "aside audio button canvas datalist dialog footer form header iframe input map menu nav noscript object option "
    "script select style svg template textarea title head video".split()
)
#: Words in class, id or role that mark such parts.
EXCLUDED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended widget widgets toolbar pagination pager copyright disclaimer search complementary contentinfo "
    "alert".split()
)
#: Marks that can stand on a wrapper of the content.
WRAPPERS = frozenset(
    "<form> widget widgets header masthead banner modal overlay popup notice alert search toolbar promo related recommended "
    "newsletter subscribe subscription signup login share sharing social complementary contentinfo disclaimer".split()
)
CONTENT = frozenset(("article", "main"))
#: A new block ends an open paragraph; these bound the search for it.
SCOPES = frozenset("article main section div td th table li body html blockquote aside nav footer header form".split())
#: Elements that end an open one of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def marks(tag: str, attributes: list[tuple[str, str | None]]) -> frozenset[str]:
    """What marks an element as not content: its <tag>, words of its names, or `hidden`."""
    found = {f"<{tag}>"} if tag in EXCLUDED else set()
    if tag in ("html", "body"):
        return frozenset()
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.add("hidden")
        if not value:
            continue
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            found.add("hidden")
        if name in ("class", "id", "role"):
            words = set(_NAMES.findall(_CAMEL.sub(r"\1 \2", value).lower()))
            words &= EXCLUDED_NAMES
            # An article or main element is content unless it is a reader's comment or an advert.
            if tag not in CONTENT or words - {"header", "footer", "related", "notice", "search"}:
                found |= words
    return frozenset(found)


class Line(NamedTuple):
    """A block of a page; `under` holds the marks it lies under, None where one is never opened."""

    text: str
    tags: int
    under: frozenset[str] | None
    container: int


class Element(NamedTuple):
    tag: str
    marks: frozenset[str]


class Lines(HTMLParser):
    """Blocks of a page as lines, and the parent of each container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements; an inline element that ended under open blocks leaves None.
        self.stack: list[Element | None] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        #: Number and place of open containers.
        self.containers: list[tuple[int, int]] = [(0, -1)]
        self.parents = [0]
        self.marked: dict[str, int] = {}
        self.closed = 0
        self.under: frozenset[str] | None = frozenset()
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[Line] = []
        self.content: set[int] = set()

    def mark(self, names: frozenset[str], by: int) -> None:
        """Count an element's marks in (1) or out (-1)."""
        if not names:
            return
        if not names <= WRAPPERS:
            self.closed += by
        else:
            for name in names:
                self.marked[name] = self.marked.get(name, 0) + by
                if not self.marked[name]:
                    del self.marked[name]
        self.under = None if self.closed else frozenset(self.marked)

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words or self.tags:
            self.lines.append(Line(" ".join(words), self.tags, self.under, self.containers[-1][0]))
        self.text, self.tags = [], 0

    def cut(self, place: int) -> None:
        """End the open elements from `place` on."""
        while len(self.stack) > place:
            element = self.stack.pop()
            if element is not None:
                self.places[element.tag].pop()
                self.mark(element.marks, -1)
        while self.containers[-1][1] >= place:
            self.containers.pop()

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def end_open(self, names: tuple[str, ...], scopes: frozenset[str]) -> None:
        place = self.last(names)
        if place >= 0 and place > self.last(scopes):
            self.cut(place)

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag not in INLINE:
            self.flush()
            if tag in SIBLINGS:
                self.end_open(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table", "select", "menu")) - {tag})
            else:
                self.end_open(("p",), SCOPES)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        element = Element(tag, marks(tag, attributes))
        self.places[tag].append(len(self.stack))
        self.stack.append(element)
        self.mark(element.marks, 1)
        if tag not in INLINE:
            self.parents.append(self.containers[-1][0])
            self.containers.append((len(self.parents) - 1, len(self.stack) - 1))
            if tag in CONTENT and self.under is not None:
                self.content.add(len(self.parents) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        place = self.last((tag,))
        if place < 0:
            return
        if tag not in INLINE:
            self.cut(place)
        elif place > self.last(SCOPES):
            # An inline element stays open under blocks that were opened in it.
            self.mark(self.stack[place].marks, -1)
            self.places[tag].pop()
            self.stack[place] = None

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel's weight beyond the ends is left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def cluster(lines: list[Line], opened: frozenset[str]) -> np.ndarray:
    """Lines whose smoothed ratio stands out, outside marks that are not `opened`."""
    inside = np.array([line.under is not None and line.under <= opened for line in lines])
    ratios = np.array([len(line.text) / max(1, line.tags) for line in lines]) * inside
    smooth = smoothed(ratios)
    return (smooth >= CUT * smooth.std()) & inside & np.array([bool(line.text) for line in lines])


def wrappers(lines: list[Line]) -> frozenset[str]:
    """Marks that stand on wrappers of the content: most running text lies under them."""
    opened: frozenset[str] = frozenset()
    if not any(line.under for line in lines):
        return opened
    found = [line for line, content in zip(lines, cluster(lines, WRAPPERS)) if content]
    total = sum(len(line.text) for line in found)
    while True:
        held: dict[str, int] = defaultdict(int)
        for line in found:
            for name in line.under - opened:
                held[name] += len(line.text)
        closed = sum(len(line.text) for line in found if line.under - opened)
        if closed < max(MOST * total, RUNNING):
            return opened
        opened |= {max(held, key=lambda name: (held[name], name))}


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by blank lines."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    opened = wrappers(lines)
    chosen = cluster(lines, opened)
    free = [line.under is not None and line.under <= opened and line.text != "" for line in lines]
    if not chosen.any():
        chosen = np.array(free)
    held = [0] * len(parents)
    for line, content in zip(lines, chosen):
        if content:
            held[line.container] += len(line.text)
    # A container's number is above its parent's.
    for n in range(len(parents) - 1, 0, -1):
        held[parents[n]] += held[n]
    regions = {n for n in parser.content if held[n]}
    if not regions:
        # Containers are numbered in page order, so the last that holds enough is the innermost.
        regions = {max(n for n, size in enumerate(held) if size >= MOST * held[0])} if held[0] else {0}
    within = [0 in regions] * len(parents)
    for n in range(1, len(parents)):
        within[n] = n in regions or within[parents[n]]
    return "\n\n".join(line.text for line, stays in zip(lines, free) if stays and within[line.container])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
