"""Main text of web pages by line-block distribution.

A page becomes a list of lines, one a block element. Lines of menus, headers,
footers, sidebars, notices, adverts, forms and comments, and text in links,
count as empty. The text lengths of ``WINDOW`` lines in a row are summed; where
the sum rises over a threshold the main text begins (a surge), where it falls
to nothing it ends (a dive). The text between is kept, however light beside
other such runs. Short lines that no window finds stay if they stand in the
element that holds the runs, between two runs, or as paragraphs after the last.

Work and memory are linear in the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 86

#: Fixed values of HTML: elements without an end tag, those that end a line, and those whose text is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NO_TEXT = frozenset("applet audio button canvas datalist embed head iframe map math noembed noframes noscript object option script select style svg template textarea title video".split())
#: Elements, roles and words of class and id attributes that mark what is not main text.
ASIDE = frozenset("aside dialog footer form menu nav search".split())
#: Those that are aside only outside the article, where they hold its title.
HEADS = frozenset("header hgroup masthead topbar".split())
#: Words that speak for main text beside one of NAMES.
MAIN_NAMES = frozenset("article entry main post story".split())
ROLES = frozenset("banner complementary contentinfo dialog alert form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that an open paragraph does not contain.
ENDS_P = BLOCKS - {"caption", "dd", "dt", "li", "body", "head", "html", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
CONTAINERS = frozenset("article div main section td blockquote li dd".split())

#: Elements of running text: inside an article their class does not make them an aside.
RUNNING = frozenset("a abbr b blockquote cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q s small span strong sub sup td th tr u".split())
PARAGRAPHS = frozenset("blockquote p pre".split())
#: How a line that speaks of rights begins.
RIGHTS = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.IGNORECASE)
SEMANTIC = frozenset(("article", "main"))
LISTS = frozenset("dl menu ol table ul".split())
#: Which open elements an item of a list or table ends.
ITEMS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|xmp)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


@dataclass
class Line:
    text: str
    plain: int  # characters outside links and spaces; 0 for what is not main text
    holder: int  # the innermost open container; 0 if none
    tag: str  # the innermost open block


@dataclass
class Container:
    tag: str
    parent: int


def _is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ASIDE or tag in HEADS and not in_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    running = in_article and tag in RUNNING
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and not running:
            words = set(WORD.findall(value))
            if words & {"comment", "comments"}:
                return True
            if tag != "article" and not words & MAIN_NAMES and (words & NAMES or not in_article and words & HEADS):
                return True
    return False


class Reader:
    """Lines of a page, read tag by tag; what is open is looked up by tag, never searched."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.containers = [Container("", 0)]
        self.stack: list[tuple[str, bool, int]] = []  # tag, aside, the container around
        self.open: dict[str, list[int]] = {}  # by tag, where it stands in the stack
        self.blocks: list[int] = []
        self.scopes: list[int] = []  # containers, beyond which an end of paragraph does not reach
        self.lists: list[int] = []
        self.holder = self.asides = self.linked = 0
        self.parts: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            size = len(text) - text.count(" ")
            self.lines.append(Line(text, max(0, size - self.linked), self.holder, self.stack[self.blocks[-1]][0] if self.blocks else ""))
        self.parts.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        if not self.asides:
            text = html.unescape(text)
            self.parts.append(text)
            if self.open.get("a"):
                self.linked += len("".join(text.split()))

    def _last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _push(self, tag: str, aside: bool) -> None:
        at = len(self.stack)
        self.stack.append((tag, aside, self.holder))
        self.open.setdefault(tag, []).append(at)
        self.asides += aside
        if tag in BLOCKS:
            self.blocks.append(at)
        if tag in LISTS:
            self.lists.append(at)
        if tag in CONTAINERS:
            self.scopes.append(at)
            self.containers.append(Container(tag, self.holder))
            self.holder = len(self.containers) - 1

    def _pop(self) -> None:
        tag, aside, self.holder = self.stack.pop()
        self.open[tag].pop()
        self.asides -= aside
        if tag in SEMANTIC:
            self.lines.append(Line("", 0, self.holder, tag))  # what follows is another run
        for known, kinds in ((self.blocks, BLOCKS), (self.lists, LISTS), (self.scopes, CONTAINERS)):
            if tag in kinds:
                known.pop()

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            self._pop()

    def end(self, tag: str) -> None:
        block, at = tag in BLOCKS, self._last(tag)
        if block:
            self.end_line()
        if at >= 0 and (block or not self.blocks or self.blocks[-1] < at):  # an inline end tag does not close blocks
            self._close(at)

    def start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self.end_line()
            if tag in ENDS_P:
                paragraph = self._last("p")
                if paragraph >= 0 and (not self.scopes or self.scopes[-1] < paragraph):
                    self._close(paragraph)
            elif tag in ITEMS:
                item = self._last(*ITEMS[tag])
                if item >= 0 and (not self.lists or self.lists[-1] < item):
                    self._close(item)
        elif tag == "br":
            self.add(" ")
        if tag in VOID:
            return
        aside = tag in NO_TEXT or _is_aside(tag, attributes, bool(self.open.get("article") or self.open.get("main")))
        if tag in SEMANTIC and not aside:
            while self.asides:  # an aside that was never closed
                self._pop()
        if block and (aside or tag in SEMANTIC):
            self.lines.append(Line("", 0, self.holder, tag))
        self._push(tag, aside)


def lines(page: str) -> tuple[list[Line], list[Container]]:
    """All lines of a page in order, and the containers they name; each container comes after its parent."""
    reader, at = Reader(), 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            reader.add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if tag and (token[2] or token[5]):
            reader.end(tag)
        elif tag:
            reader.start(tag, token[4] or token[7] or "")
    if at < len(page):
        reader.add(page[at:])
    reader.end_line()
    return reader.lines, reader.containers


def spans(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, after the last) of each run of lines between a surge and its dive."""
    sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    if not sums or not max(sums):
        return []
    limit, out, i = min(surge, max(sums)), [], 0
    while i < len(sums):
        if sums[i] < limit or not sizes[i]:
            i += 1
            continue
        first = i
        while i < len(sums) and sizes[i]:
            i += 1
        while first and sizes[first - 1]:
            first -= 1
        out.append((first, i))
    return out


def _held(weights: list[int], containers: list[Container], found: list[Line]) -> list[int]:
    """The weight that each container holds at any depth."""
    held = [0] * len(containers)
    for line, weight in zip(found, weights, strict=True):
        held[line.holder] += weight
    for n in range(len(containers) - 1, 0, -1):
        held[containers[n].parent] += held[n]
    return held


def _common(holders: list[int], containers: list[Container]) -> int:
    """The innermost container around all of ``holders``: that of the first and the last, as numbers go by place."""
    low, high = min(holders), max(holders)
    while low != high:
        if high > low:
            high = containers[high].parent
        else:
            low = containers[low].parent
    return low


def main_text(page: str | None) -> str:
    """The main text: its blocks in page order, joined by an empty line; empty if there is none."""
    found, containers = lines(page or "")
    sizes = [x.plain for x in found]
    runs = spans(sizes)
    if not runs:
        return ""
    inside = [False] * len(found)
    for first, after in runs:
        inside[first:after] = [True] * (after - first)
    # the element of the heavy runs, article or main if one does, and those of the runs outside it
    heaviest = max(sum(sizes[a:b]) for a, b in runs)
    heavy = [0] * len(found)
    for a, b in runs:
        if 4 * sum(sizes[a:b]) >= heaviest:
            heavy[a:b] = sizes[a:b]
    held, total = _held(heavy, containers, found), sum(heavy)
    whole = [n for n in range(1, len(containers)) if 5 * held[n] >= 4 * total]
    semantic = [n for n in whole if containers[n].tag in SEMANTIC]
    holders = {_common([x.holder for x in found[a:b]], containers) for a, b in runs} - {0, *whole}
    if whole:
        holders.add(max(semantic or whole))
    kept = [n in holders for n in range(len(containers))]
    for n in range(1, len(containers)):
        kept[n] |= kept[containers[n].parent]
    # paragraphs from the first run to the last plain one, links alone included
    last = runs[-1][1]
    if not semantic:
        last = max((i + 1 for i in range(last, len(found)) if found[i].tag in PARAGRAPHS and found[i].plain and not RIGHTS.match(found[i].text)), default=last)
    for i, line in enumerate(found):
        inside[i] |= kept[line.holder] or runs[0][0] <= i < last and line.tag in PARAGRAPHS and not RIGHTS.match(line.text)
    return "\n\n".join(x.text for x, good in zip(found, inside, strict=True) if good and x.text)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per input row.

    A null page is empty; a page without main text gives the empty text.
    ``n_chars`` counts code points. Other columns of ``pages`` are not read.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(compute, "page_id long, url string, text string, n_chars long")
