"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block
elements. Text length (without links) and punctuation are added up per path and
divided by the path's blocks. The two series are smoothed over the page, where
blocks of the same path weigh fully and others little, and fused into one, with
the spread of the path's text lengths, as running text varies and notices
don't; a path's value is the mean over its blocks, and paths are thresholded by the
spread of the values and by the largest one. The blocks of the paths that reach
the threshold are the article, with the headings that belong to them and the
lists and quotations that stand beside them; all other blocks go. Where a page has
an ``article`` or ``main`` with running text, only paths inside are compared, and
of each such element with a chosen block all blocks stay but those with a telling
name and those that are mostly links: sections, captions, tables, short lines.

Before that, elements that can't be article by HTML's own meaning are left out:
menus, footers, asides, forms, scripts and the like, and what is hidden; but a
form around more than half of the page's text is the page's frame, no form.
Class names and ids (advert, sidebar, comments and so on) only lower a path's
value, so a telling name on the article itself takes nothing away.

A page is worked on alone, in one narrow pass without a shuffle and in time in
proportion to its length, however deep elements nest.

Defined cases: null and empty pages, and pages without text, give ''; broken
or unclosed markup is read as browsers read it, as far as blocks go; very long
pages are read whole; ties in the values are all selected; repeated rows give
repeated results; an empty table gives an empty result; extra columns are left
alone.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import slices, small_batches, table

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes".split())
BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary center nav header footer aside form fieldset menu dialog".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
LIST = set("ul ol dl blockquote pre".split())
LISTED = LIST | {"li", "dt", "dd", "p"}
#: Elements that the start of the key's element closes, up to a wall.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALL = set("html body ul ol dl table article section div main blockquote".split())

# Elements, roles and name parts of what isn't the article.
APART = set("head nav footer aside form button select option template svg canvas object audio video dialog menu fieldset label input datalist".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widgets?|related|recommend(?:ed|ations?)?|share|sharing|social|footer|masthead|"
    r"toolbar|pagination|pager|comments?|commentlist|disqus|respond|replies|reply|search|skip|copyright|legal|disclaimer|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SPACES = re.compile(r"\s+")


#: Value of a path whose names say that it isn't the article.
NAMED = 0.1
#: Weight in the smoothing of a neighbour of another path.
STRANGE = 0.03
#: Threshold: shares of the values' standard deviation and of the largest value.
SPREAD, LARGEST = 0.5, 0.15


class Element:
    """An open element. It knows its parent, so nothing is copied per block."""

    __slots__ = ("name", "parent", "apart", "article", "region", "formed", "linked", "path", "leaf")

    def __init__(self, name: str, parent: Element | None, apart: bool, path: int, leaf: str):
        self.name, self.parent, self.path, self.leaf = name, parent, path, leaf
        self.apart = apart or (parent is not None and parent.apart)
        self.article = name in ("article", "main") or (parent is not None and parent.article)
        # the outermost article or main around
        self.region = parent.region if parent is not None and parent.article else self if self.article else None
        self.formed = name == "form" or (parent is not None and parent.formed)
        self.linked = name == "a" or (parent is not None and parent.linked)


class Block:
    """A text block: ``path`` numbers its tag path, ``element`` is the block
    element around it, ``linked`` the length of its links."""

    __slots__ = ("path", "element", "parts", "linked", "tag", "text")

    def __init__(self, top: Element | None):
        self.path, self.tag = (top.path, top.leaf) if top else (0, "")
        self.element, self.linked, self.text = top, 0, ""
        self.parts: list[str] = []


def _kind(name: str, attributes: str, inside: bool, forms: bool = False) -> tuple[bool, bool]:
    """Whether an element can't be part of an article, and whether its class or
    id tells against it. inside: of article or main; forms: these may be part."""
    if name == "form" and forms:
        return False, False
    if name in APART or (name == "header" and not inside):
        return True, False
    if not attributes.strip() or name in ("html", "body"):
        return False, False
    found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True, False
    if name in ("main", "article"):
        return False, False
    if found.get("role", "").lower() in ROLES:
        return True, False
    named = f"{found.get('class', '')} {found.get('id', '')}"
    return False, bool(named.strip() and NAMES.search(named))


class Page:
    """The text blocks of a page, in order, and its tag paths: ``named`` and
    ``article`` tell of each path whether a name on it tells against it, and
    whether it is in an article."""

    def __init__(self, page: str, forms: bool = False):
        self.forms = forms
        self.blocks: list[Block] = []
        self.named, self.article = [False], [False]
        self._numbers: dict[tuple, int] = {}
        self._stack: list[Element] = []
        self._open: defaultdict[str, int] = defaultdict(int)
        self._now: Block | None = None
        self._read(page)
        for b in self.blocks:
            b.text = SPACES.sub(" ", html.unescape("".join(b.parts))).strip()
            b.parts = []
        self.blocks = [b for b in self.blocks if b.text]

    def _text(self, s: str) -> None:
        top = self._stack[-1] if self._stack else None
        if not s or (top is not None and top.apart):
            return
        if self._now is None:
            if s.isspace():
                return
            self._now = Block(top)
            self.blocks.append(self._now)
        self._now.parts.append(s)
        if top is not None and top.linked:
            self._now.linked += len(s)

    def _start(self, name: str, attributes: str) -> None:
        parent = self._stack[-1] if self._stack else None
        apart, named = _kind(name, attributes, parent is not None and parent.article, self.forms)
        above = parent.path if parent else 0
        path, leaf = above, parent.leaf if parent else ""
        if name in BLOCK:
            leaf = name
            path = self._numbers.setdefault((above, name, named), len(self.named))
            if path == len(self.named):
                self.named.append(self.named[above] or named)
                self.article.append(self.article[above] or name in ("article", "main"))
        elif named:  # an inline element with a telling name
            path = self._numbers.setdefault((above, "", named), len(self.named))
            if path == len(self.named):
                self.named.append(True)
                self.article.append(self.article[above])
        self._stack.append(Element(name, parent, apart, path, leaf))
        self._open[name] += 1

    def _close(self, k: int) -> None:
        for x in self._stack[k:]:
            self._open[x.name] -= 1
            if x.name in BLOCK:
                self._now = None
        del self._stack[k:]

    def _close_first(self, names: set[str]) -> None:
        """Close the innermost of ``names``, up to a wall."""
        if not any(self._open[n] for n in names):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].name in names:
                return self._close(k)
            if self._stack[k].name in WALL:
                return None

    def _end(self, name: str) -> None:
        if not self._open[name]:
            if name == "p":
                self._now = None
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].name == name:
                return self._close(k)
            if self._stack[k].name in WALL and name not in BLOCK:
                return None

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = TAG.search(page, at)
            if m is None:
                self._text(page[at:])
                break
            self._text(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if page.startswith("<![CDATA[", m.start()):
                    self._text(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            if m[1] or m[4]:
                self._end(name)
                continue
            attributes = m[3] if m[2] else m[6] or ""
            if name in VOID:
                if name == "hr":
                    self._now = None
                elif name == "br" and self._now is not None:
                    self._now.parts.append(" ")
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            if name in BLOCK:
                self._close_first({"p"})
                self._now = None
            if name in CLOSES:
                self._close_first(CLOSES[name])
            if not (attributes.rstrip().endswith("/") and name in ("svg", "path")):
                self._start(name, attributes)


def ratios(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text length and punctuation of each block's path, per block of it, and
    the standard deviation of the lengths."""
    path = np.array([b.path for b in page.blocks])
    size = np.array([max(0, len(b.text) - b.linked) for b in page.blocks], float)
    marks = np.array([len(MARKS.findall(b.text)) if len(b.text) > b.linked else 0 for b in page.blocks], float)
    count = np.maximum(np.bincount(path), 1)
    mean = np.bincount(path, size) / count
    spread = np.sqrt(np.bincount(path, (size - mean[path]) ** 2) / count)
    return mean[path], (np.bincount(path, marks) / count)[path], spread[path]


def smooth(x: np.ndarray, path: np.ndarray) -> np.ndarray:
    """A Gaussian over two neighbours on either side, in which blocks of
    another path weigh ``STRANGE``."""
    total, weight = x.copy(), np.ones(len(x))
    for gap in (1, 2):
        w = np.exp(-(gap**2) / 2.0) * np.where(path[gap:] == path[:-gap], 1.0, STRANGE)
        total[gap:] += w * x[:-gap]
        total[:-gap] += w * x[gap:]
        weight[gap:] += w
        weight[:-gap] += w
    return total / weight


def selected(page: Page) -> np.ndarray:
    """Which blocks stand on content paths."""
    path = np.array([b.path for b in page.blocks])
    size, marks, spread = ratios(page)
    fused = smooth(size, path) * np.log1p(smooth(marks, path) + 0.5) * (1 + np.log1p(spread))
    article = np.array(page.article)
    named = np.array(page.named)
    lowered = np.where(named, NAMED, 1.0)
    if (article & ~named)[path][size > 0].any():
        lowered = lowered * article
    count = np.bincount(path, minlength=len(lowered))
    value = np.bincount(path, fused, minlength=len(lowered)) / np.maximum(count, 1) * lowered
    value = value[path]
    return value >= max(min(SPREAD * value.std(), value.max()), LARGEST * value.max())


def _block(e: Element | None) -> Element | None:
    while e is not None and e.name not in BLOCK:
        e = e.parent
    return e


def completed(page: Page, chosen: np.ndarray) -> np.ndarray:
    """``chosen`` and what belongs to it: headings right before a chosen block,
    or of an element, smaller than the body, that holds one; lists and
    quotations, if no links, in the same element as a chosen block; and all of an
    article that holds one, if no links and without a telling name."""
    regions = {id(b.element.region) for b, c in zip(page.blocks, chosen) if c and b.element is not None and b.element.region is not None}
    holds: set[int] = set()
    beside: set[int] = set()
    for b, c in zip(page.blocks, chosen):
        e = _block(b.element) if c and b.tag not in HEADING else None
        if e is not None and e.parent is not None:
            beside.add(id(_block(e.parent)))
        while e is not None and id(e) not in holds and e.name not in ("body", "html"):
            holds.add(id(e))
            e = e.parent
    out, following = chosen.copy(), False
    for k in range(len(page.blocks) - 1, -1, -1):
        b = page.blocks[k]
        if b.tag in HEADING:
            e = b.element
            while e.name not in HEADING:
                e = e.parent
            around = _block(e.parent)
            out[k] = following or (around is not None and id(around) in holds) or (id(b.element.region) in regions and not page.named[b.path])
            continue
        following = bool(chosen[k])
        if b.element is not None and id(b.element.region) in regions and 2 * b.linked < len(b.text) and not page.named[b.path]:
            out[k] = following = True
            continue
        if not chosen[k] and 2 * b.linked < len(b.text) and not page.named[b.path] and b.tag in LISTED:
            e = b.element
            while e is not None and e.name not in LIST and (e.name in LISTED or e.name not in BLOCK):
                e = e.parent
            out[k] = e is not None and e.name in LIST and id(_block(e.parent)) in beside
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    read = Page(page or "")
    if re.search("<form", page or "", re.I):
        whole = Page(page, forms=True)
        inside = sum(len(b.text) for b in whole.blocks if b.element is not None and b.element.formed)
        if 2 * inside > sum(len(b.text) for b in whole.blocks):
            read = whole
    if not read.blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(read.blocks, completed(read, selected(read))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
