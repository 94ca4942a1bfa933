"""Main text of web pages: parser events, text-to-tag ratio per line,
Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into blocks, the lines
of the method: a block ends at every tag of a block element. A block knows its
text, how many tags stand in it, and the open elements around it. Blocks
inside elements that are never main text (navigation, header, footer, aside,
script, style) are out, whatever their density, as are forms and elements whose
class, id or role says menu, advert, notice, comment and the like, unless the
page has no content without them: where no ``article`` or ``main`` is left, such an
element that holds one stays, and where there is none at all, one that holds most of the page's text.

The ratio of text to tags of the remaining blocks is smoothed with a Gaussian
kernel over neighbouring blocks; blocks at least as dense as the threshold
(the mean of the smoothed ratios less their deviation, in steps towards the
page's densest block) form clusters. A cluster stands for its region: the innermost
``article`` or ``main`` around it, at any depth, or the page body.
The region with the most text in clusters is the content, and all its blocks
are the text, short ones too: nothing inside the article is dropped or cut.
Elements of equal kind beside it (an article in parts) join it. On a page where
no ``article`` or ``main`` decides, the innermost container (``div``, ``section``, table
cell and the like) that holds ``MOST`` of the clusters' text of those around it is the content,
and all its blocks are the text.

Null and empty pages have an empty text; unclosed, stray and nested tags are
taken as they come; repeated rows are kept.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablefill.llm.common import append_columns

SIGMA = 2.0
MOST = 0.8

BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul caption option noscript template title head""".split())
NEVER = frozenset("""nav header footer aside script style noscript template head title button select textarea
iframe object svg menu dialog canvas datalist""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
REGION = frozenset(("article", "main"))
CONTAINER = frozenset("div section table tbody tr td form center figure fieldset details dl ul ol blockquote hgroup".split())
#: A word of class, id or role that marks a part outside the main text.
ASIDE = re.compile(r"""(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo
|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|header|masthead|cookie
|cookies|consent|notice|notices|alert|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comment|comments
|disqus|replies|reply|respond|share|sharing|social|related|recommended|recommendations|tags|pagination|pager|search
|complementary|contentinfo)(?:$|[\s_-])""".replace("\n", ""), re.I)
_SPACE = re.compile(r"\s+")
_OPEN_TAG = re.compile(r"<(?:([a-zA-Z][a-zA-Z0-9]*)|[/!?])")


_NEGATED = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without|is|hide|hides|show|shows)[-_][\w-]*", re.I)


class Element(NamedTuple):
    """An element: its name, the number of the element around it (-1: none),
    whether it is never main text, and whether it says that it is none."""
    tag: str
    up: int
    never: bool
    marked: bool


class Blocks(HTMLParser):
    """Elements of a page and its blocks: ``(text, tags, number of the element around it)``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # name and number
        self.elements: list[Element] = []
        self.blocks: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.tags, self.stack[-1][1] if self.stack else -1))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends an open one
            self._close("p", stop=BLOCK)
        elif tag == "li":
            self._close("li", stop=("ul", "ol", "menu"))
        elif tag in ("article", "main"):  # never part of these: they were left open
            self._close("nav")
            self._close("header")
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        marked = tag == "form" or any(v and ASIDE.search(_NEGATED.sub(" ", v)) for k, v in attrs if k in ("class", "id", "role"))
        body = tag in ("body", "html", "article", "main")
        self.elements.append(Element(tag, self.stack[-1][1] if self.stack else -1, tag in NEVER or hidden, marked and not body))
        self.stack.append((tag, len(self.elements) - 1))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def _close(self, tag, stop=()):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in stop or (tag not in BLOCK and self.stack[i][0] in BLOCK):
                return

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, 0)  # "<![...>" is a comment in HTML

    def finish(self) -> None:
        """End of the page: a tag that never ended ends at its first ">", an
        open comment or a tag without one is dropped."""
        while (tag := _OPEN_TAG.match(self.rawdata)) and not self.cdata_elem:
            cut = -1 if self.rawdata.startswith("<!--") else self.rawdata.find(">")
            rest, self.rawdata = self.rawdata[cut + 1:] if cut >= 0 else "", ""
            self.feed((f"<{tag[1]}>" if tag[1] and cut >= 0 else "") + rest)
        self.close()
        self.flush()

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][0] in RAW):
            self.parts.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbours; weights beyond an end are left out."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    keep = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[keep] / np.convolve(np.ones(len(ratio)), kernel)[keep]


def visible(blocks: list[tuple[str, int, int]], elements: list[Element]) -> list[bool]:
    """For each element (last: the page) whether its text can be main text."""
    count = len(elements)

    def shown(back: set[int]) -> list[bool]:
        seen = [True] * (count + 1)
        for i, e in enumerate(elements):
            seen[i] = seen[e.up] and not e.never and (not e.marked or i in back)
        return seen

    def sizes(seen: list[bool]) -> list[int]:
        size = [0] * (count + 1)
        for text, _, i in blocks:
            size[i] += len(text) * seen[i]
        for i in range(count - 1, -1, -1):
            size[elements[i].up] += size[i]
        return size

    seen = shown(set())
    size = sizes(seen)
    if any(e.tag in REGION and size[i] for i, e in enumerate(elements)):
        return seen
    every = shown(set(range(count)))
    full = sizes(every)
    holds = [False] * (count + 1)
    for i in range(count - 1, -1, -1):
        holds[i] = holds[i] or (elements[i].tag in REGION and full[i] > 0)
        holds[elements[i].up] |= holds[i]
    back = {i for i, e in enumerate(elements) if e.marked and holds[i]}
    if not back:  # no region at all: a marked element that holds most of the text is the page's body
        back = {i for i, e in enumerate(elements) if e.marked and 2 * full[i] > full[-1] and full[i] > size[-1]}
    return shown(back)


def content_blocks(blocks: list[tuple[str, int, int]], elements: list[Element]) -> list[str]:
    """Texts of the blocks in the selected content region, in page order."""
    seen = visible(blocks, elements)
    kept = [(text, tags, i) for text, tags, i in blocks if seen[i]]
    if not kept:
        return []
    smooth = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in kept]))
    dense = smooth >= max(smooth.mean() - smooth.std(), 0.1 * smooth.max())
    # the innermost region of each element, and the text of clusters directly in it
    inner = [-1] * (len(elements) + 1)
    for i, e in enumerate(elements):
        inner[i] = i if e.tag in REGION else inner[e.up]
    weight = [0] * (len(elements) + 1)
    for (text, _, i), is_dense in zip(kept, dense, strict=True):
        weight[i] += len(text) * int(is_dense)
    for i in range(len(elements) - 1, -1, -1):
        weight[elements[i].up] += weight[i]
    below: dict[int, list[int]] = {}
    for i, e in enumerate(elements):
        if e.tag in REGION and weight[i]:
            below.setdefault(inner[e.up], []).append(i)
    # from the page down, follow an article or main part while it holds text
    region = -1
    while region in below:
        best = max(below[region], key=lambda i: (weight[i], -i))
        if weight[best] * 2 < weight[region] - sum(weight[i] for i in below[region]):
            break
        beside = {i for i in below[region] if elements[i].tag == elements[best].tag}
        if len(beside) > 1:  # parts of equal kind: all of them
            return [text for text, _, i in kept if within(elements, i, beside)]
        region = best
    if region < 0:
        return [text for text, _, i in kept if within(elements, i, {container(elements, weight)})]
    return [text for text, _, i in kept if within(elements, i, {region})]


def container(elements: list[Element], weight: list[int]) -> int:
    """From the page down, the innermost container with MOST of the clusters' text of the one above it."""
    inside: dict[int, list[int]] = {}
    for i, e in enumerate(elements):
        inside.setdefault(e.up, []).append(i)
    at = found = -1
    while at in inside:
        best = max(inside[at], key=lambda i: (weight[i], -i))
        if not weight[best] or weight[best] < MOST * weight[at]:
            break
        at = best
        if elements[at].tag in CONTAINER or elements[at].tag in ("body", "html"):
            found = at
    return found


def within(elements: list[Element], i: int, any_of: set[int]) -> bool:
    """Whether an element is, or lies in, one of some elements (-1: the page)."""
    if -1 in any_of:
        return True
    while i >= 0 and i not in any_of:
        i = elements[i].up
    return i >= 0


def main_text(html: str) -> str:
    parser = Blocks()
    parser.feed(html)
    parser.finish()
    return "\n\n".join(content_blocks(parser.blocks, parser.elements))


def with_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """``pages`` plus the main text of each page."""
    return append_columns(pages, html_col, StructType([StructField(out_col, StringType())]),
                          lambda: lambda pages: [[main_text(x) for x in pages.to_pylist()]])


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: its main text and the text's code points."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return with_main_text(rows, "html", "text").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
