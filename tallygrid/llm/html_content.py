"""Main text of web pages by the best contiguous region of words and tags.

A page becomes a sequence of scored items: words count for, tags against, and so do words of
elements that are marked as something beside the text (menus, notices, adverts, forms, reader
comments ...).  The weights are log-odds of an item inside and outside of the content of
labelled pages, kept positive for words and negative for tags; items seen too rarely there
have a stated prior.  One linear scan finds the region of the greatest sum.  The region is
then rounded to the element that it lies in, and its blocks of text, without those of marked
elements, are the main text.

Pages are handled one by one inside a task: there is no shuffle, and memory is bounded by one
Arrow batch.  ``fit`` adds up counts of a fixed vocabulary of items over a bounded sample of
labelled pages; only those sums reach the driver.

Defined cases: NULL and empty pages have an empty text, as have pages without words outside
of marked elements, unless everything is marked: then marks other than of scripts, styles and
the head are ignored.  A page without tags is its own text.  What follows an unclosed comment,
script or style is lost with it, as in a browser; unclosed elements end with their parent, a
page that breaks off ends where it does.  Ties of regions go to the first, then the shortest.
Repeated pages are extracted each for itself; an empty table gives no rows; only columns
named in ``keep`` are carried, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labelled pages that weights are fitted on, at most about so many.
SAMPLE_PAGES = 5000
# An item seen less often on labelled pages keeps its prior.
SUPPORT = 20

# ---- fixed values: names of HTML and of what publishers call their boilerplate ----
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source "
    "track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes title xmp svg "
                "object video audio canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option optgroup p pre search section select summary table tbody td "
    "tfoot th thead title tr ul button br".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link "
    "mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Blocks that hold text rather than other parts of a page.
TEXT_BLOCKS = frozenset(
    "blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th caption".split())
CONTAINERS = frozenset("article main section div body html td center".split())
# A block that opens ends these, up to the nearest element of BOUNDS.
ENDED_BY = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option",),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
BOUNDS = frozenset(
    "article aside body div dl fieldset footer form header html main nav ol section table td th "
    "ul blockquote details dialog figure".split())
MARKED_TAGS = frozenset(
    "nav footer aside form button select dialog menu search datalist fieldset head".split())
MARKED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu "
    "menubar toolbar tablist status".split())
MARKED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit banner "
    "sponsor sponsored sponsors promo promoted promotion nav navbar navigation navi topnav subnav "
    "menu menubar submenu breadcrumb breadcrumbs sidebar sidenav rail aside footer masthead cookie "
    "cookies consent gdpr notice notices notification alert toast popup modal overlay newsletter "
    "subscribe subscription signup login signin paywall register social share sharing sharebar "
    "related recommended recommendations trending popular comment comments commentlist "
    "commentform respond reply replies discussion disqus pagination pager toolbar widget widgets "
    "copyright legal skiplink outbrain taboola metabar".split())
# "header" marks a page's head, not an article's; these say which.
HEADER_OF_PAGE = frozenset("header site-header page-header top-header main-header global-header "
                           "siteheader pageheader topbar".split())
NOT_HOLDING = ("with", "has", "no", "without", "hide", "show")
NEVER_MARKED = frozenset("html body article main".split())

# Prior weights, and the range that weights of labelled pages are kept in.
PRIOR = {"word": 1.0, "link": 0.2, "marked": -0.5, "inline": -0.1, "text": -0.3, "part": -1.5,
         "aside": -4.0}
RANGE = {"word": (0.05, 1.0), "link": (0.01, 1.0), "marked": (-1.0, -0.05)}
TAG_RANGE = (-4.0, -0.05)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(>|\Z)",
    re.S,
)
_MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)"""
                    r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}


def kind_of(name: str) -> str:
    """The prior's kind of a tag."""
    if name in MARKED_TAGS:
        return "aside"
    if name in INLINE:
        return "inline"
    return "text" if name in TEXT_BLOCKS or name == "br" else "part"


def vocabulary() -> list[str]:
    """All items that have a weight: kinds of words, opening and closing tags."""
    names = sorted(VOID | BLOCKS | INLINE | {"other", "marked"})
    return ["word", "link", "marked", *(f"<{n}" for n in names), *(f"</{n}" for n in names)]


def prior(item: str) -> float:
    if item in PRIOR:
        return PRIOR[item]
    name = item.lstrip("</")
    return PRIOR["aside" if name == "marked" else kind_of(name)]


def marked(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is named, or calls itself, something beside the text."""
    if name in NEVER_MARKED:
        return False
    if name in MARKED_TAGS or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    for m in _MARKS.finditer(attributes):
        what = m[1].lower()
        value = next((g for g in m.groups()[1:] if g is not None), "")
        if what == "role" and value.lower() in MARKED_ROLES:
            return True
        if what == "hidden" or what == "aria-hidden" and value.lower() == "true":
            return True
        if what == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if what in ("class", "id"):
            for one in value.split():
                if not in_article and one.lower() in HEADER_OF_PAGE:
                    return True
                parts = [p.lower() for p in _PARTS.split(one) if p] if not one.islower() \
                    else [p for p in _PARTS.split(one) if p]
                if parts and parts[0] not in NOT_HOLDING and not MARKED_WORDS.isdisjoint(parts):
                    return True
    return False


class Page:
    """Items, blocks and elements of a page.

    ``items`` are ``(item, count, offset, block)``; a block is the number of a list of pieces of
    text, or -1.  ``nodes`` are ``[parent, name, begin, end]``; ``owner`` names a block's element.
    """

    def __init__(self, html: str, honour_marks: bool = True):
        self.items: list[tuple[str, int, int, int]] = []
        self.blocks: list[list[str]] = []
        self.owner: list[int] = []
        self.nodes: list[list] = [[-1, "html", 0, len(html)]]
        self._stack = [(0, "html", False)]  # node, name, marked
        self._open: Counter = Counter({"html": 1})
        self._fresh = True
        self._honour = honour_marks
        at, end = 0, len(html)
        for_tag = _TOKEN.search
        while at < end:
            token = for_tag(html, at)
            if token is None:
                self._text(html[at:], at)
                break
            if token.start() > at:
                self._text(html[at : token.start()], at)
            at = token.end()
            name = token[2]
            if name is None or not token[4]:
                continue
            name = name.lower()
            if token[1]:
                self._close(name, token.start())
            elif name in RAW:
                found = _ENDS[name].search(html, at)
                at = found.end() if found else end
            else:
                self._tag(name, token[3], token.start(), at)
        for node, _, _ in self._stack:
            self.nodes[node][3] = end

    def _score(self, name: str, sign: str, offset: int, marks: bool) -> None:
        known = name if name in VOID or name in BLOCKS or name in INLINE else "other"
        self.items.append((sign + ("marked" if marks else known), 1, offset, -1))

    def _pop(self, offset: int) -> None:
        node, name, _ = self._stack.pop()
        self._open[name] -= 1
        self.nodes[node][3] = offset

    def _end_open(self, names: tuple[str, ...], offset: int) -> None:
        """End the outermost open element of these names within the nearest bound."""
        if not any(self._open[n] for n in names):
            return
        deepest = None
        for i in range(len(self._stack) - 1, 0, -1):
            name = self._stack[i][1]
            if name in names:
                deepest = i
            elif name in BOUNDS and not (name in ("td", "th") and "td" in names):
                break
        if deepest is not None:
            while len(self._stack) > deepest:
                self._pop(offset)

    def _tag(self, name: str, attributes: str, begin: int, end: int) -> None:
        if name in BLOCKS:
            self._fresh = True
            if name == "body" or self._open["head"] and name not in ("head", "html"):
                while self._open["head"]:
                    self._pop(begin)
            if name not in ("br", "option"):
                self._end_open(("p", *ENDED_BY.get(name, ())), begin)
        within = self._stack[-1][2]
        marks = within or self._honour and marked(name, attributes, self._open["article"] > 0)
        if name == "head":
            marks = True
        self._score(name, "<", begin, marks)
        if name in VOID or name in ("html", "body") and self._open[name]:
            return
        self.nodes.append([self._stack[-1][0], name, end, -1])
        self._stack.append((len(self.nodes) - 1, name, marks))
        self._open[name] += 1

    def _close(self, name: str, offset: int) -> None:
        self._score(name, "</", offset, self._stack[-1][2])
        if name in BLOCKS:
            self._fresh = True
        if name == "html" or name in VOID or not self._open[name]:
            return
        if name in INLINE or name == "p":
            # an end tag inside another block does not reach out of it
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][1] == name:
                    break
                if self._stack[i][1] in BLOCKS and (name != "p" or self._stack[i][1] in BOUNDS):
                    return
        while self._open[name]:
            top = self._stack[-1][1]
            self._pop(offset)
            if top == name:
                break

    def _text(self, raw: str, offset: int) -> None:
        text = unescape(raw) if "&" in raw else raw
        count = len(text.split())
        node, _, marks = self._stack[-1]
        if marks:
            if count:
                self.items.append(("marked", count, offset, -1))
            return
        if self._fresh and count:
            self.blocks.append([])
            self.owner.append(self._holder(node))
            self._fresh = False
        if not self._fresh:
            self.blocks[-1].append(text)
            if count:
                kind = "link" if self._open["a"] else "word"
                self.items.append((kind, count, offset, len(self.blocks) - 1))

    def _holder(self, node: int) -> int:
        """The nearest element that is a block."""
        while node and self.nodes[node][1] not in BLOCKS:
            node = self.nodes[node][0]
        return node

    def path(self, node: int) -> list[int]:
        """The element and all that it lies in, from the inside out."""
        path = [node]
        while node:
            node = self.nodes[node][0]
            path.append(node)
        return path

    def label(self) -> tuple[int, int] | None:
        """The content of the page's only article or, without any, its only main element."""
        for name in ("article", "main"):
            found = [n for n in self.nodes if n[1] == name]
            if found:
                return (found[0][2], found[0][3]) if len(found) == 1 else None
        return None


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """``(first, last)`` of the contiguous items of the greatest positive sum."""
    best, region, total, first = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0.0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, region = total, (first, i)
    return region


def _selected(page: Page, first: int, last: int) -> list[int]:
    """Blocks of the region, rounded to the element that it lies in."""
    inside = range(first, last + 1)
    common = page.path(page.owner[first])
    for block in inside:
        mine = set(page.path(page.owner[block]))
        common = [n for n in common if n in mine]
    while common and page.nodes[common[0]][1] not in CONTAINERS:
        common.pop(0)
    for name in ("article", "main"):
        holder = next((n for n in common if page.nodes[n][1] == name), None)
        if holder is not None:
            return [b for b, o in enumerate(page.owner) if holder in page.path(o)]
    holder = common[0] if common else 0

    def goes_on(block: int) -> bool:
        owner = page.owner[block]
        return page.nodes[owner][1] in TEXT_BLOCKS and holder in page.path(owner)

    while first > 0 and goes_on(first - 1):
        first -= 1
    while last + 1 < len(page.blocks) and goes_on(last + 1):
        last += 1
    return list(range(first, last + 1))


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: its blocks joined by one space, white space made one space."""
    if not html:
        return ""
    page = Page(html)
    if not page.blocks and any(i[0] == "marked" for i in page.items):
        page = Page(html, honour_marks=False)
    region = best_region([weights[item] * count for item, count, _, _ in page.items])
    if region is None:
        return ""
    touched = [b for _, _, _, b in page.items[region[0] : region[1] + 1] if b >= 0]
    texts = ("".join(page.blocks[b]) for b in _selected(page, touched[0], touched[-1]))
    return " ".join(" ".join(texts).split())


def weights_of(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Log-odds of every item of the vocabulary, or its prior where it was hardly seen."""
    items = vocabulary()
    total_in = sum(inside.values()) + len(items)
    total_out = sum(outside.values()) + len(items)
    found = {}
    for item in items:
        a, b = inside.get(item, 0), outside.get(item, 0)
        low, high = RANGE.get(item, TAG_RANGE)
        odds = math.log((a + 1) / total_in) - math.log((b + 1) / total_out)
        found[item] = min(max(odds, low), high) if a + b >= SUPPORT else prior(item)
    return found


def fit(
    pages: DataFrame,
    html: str = "html",
    begin: str | None = None,
    end: str | None = None,
    sample_pages: int = SAMPLE_PAGES,
) -> dict[str, float]:
    """Weights from labelled pages, about ``sample_pages`` of them, chosen by hash.

    ``begin`` and ``end`` name columns with the character span of the content; without them a
    page is its own label where its publisher set the text in one article or main element.
    Pages without a label teach nothing.
    """
    total = pages.count()
    share = 1.0 if total <= sample_pages else sample_pages / total
    cut = int(share * (1 << 30))
    chosen = pages.filter(F.pmod(F.xxhash64(html), F.lit(1 << 30)) < cut)
    spans = [c for c in (begin, end) if c]
    schema = "item string, inside bigint, outside bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in batches:
            for text, *span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(text or "")
                a, b = span or page.label() or (None, None)
                if a is None or b is None:
                    continue
                for item, count, offset, _ in page.items:
                    (inside if a <= offset < b else outside)[item] += count
        items = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()),
             pa.array([inside[i] for i in items], pa.int64()),
             pa.array([outside[i] for i in items], pa.int64())],
            names=["item", "inside", "outside"])

    sums = (
        chosen.select(html, *spans).mapInArrow(work, schema)
        .groupBy("item").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).collect()
    )
    return weights_of({r["item"]: r["a"] for r in sums}, {r["item"]: r["b"] for r in sums})


def extract(
    pages: DataFrame,
    weights: dict[str, float],
    keep: tuple[str, ...] = ("page_id", "url"),
    html: str = "html",
) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) of every page."""
    source = pages.select(*keep, html)
    schema = T.StructType(source.schema.fields[:-1])
    schema.add("text", T.StringType()).add("n_chars", T.LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), weights) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=schema.names)

    return source.mapInArrow(work, schema)
