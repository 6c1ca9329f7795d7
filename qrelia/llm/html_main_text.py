"""Main text of HTML pages by tree scoring.

A page becomes a tree of block elements. Every paragraph gives points for its length and its
commas to its parent, half to the grandparent and less further up; an element's points are discounted by the share of its
text that stands inside links. The element with the most points is the article; its siblings that
are good enough stay. Elements for menus, page headers and footers, forms, scripts and styles are cut from the tree before. A class or id that
speaks of a sidebar, notice, advert and the like only casts doubt: such an element is cut too, unless it holds more than half
of the page's paragraph points (of reader comments: more than nine tenths). Words after "no-", "has-" and the like cast none.

A page without any text, a null and an empty page give an empty string. Empty tables give empty results;
repeated rows are judged one by one; columns of the input named like an output column are replaced by it.
Nothing is capped: tree depth is handled without recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template svg math canvas object iframe audio video map head title "
    "nav footer aside form button select option textarea input dialog menu".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary header hgroup center fieldset legend hr".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS | frozenset("nav footer aside form menu".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table tbody thead tfoot body article section div main blockquote".split())

_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo|banner|nav|navbar|navigation|menu|menus|breadcrumbs?|"
    r"sidebar|side-bar|aside|footer|site-header|page-header|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|notices|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widget|"
    r"pager|pagination|skip-link|hidden)(?=$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?=$|[\s_-])", re.I)
# "no-sidebar" or "has-banner" says something about the page around the element's own text.
_MODIFIED = re.compile(r"(?:^|(?<=[\s_-]))(?:no|not|has|have|with|without)[_-][^\s]*", re.I)
_MOST, _REST = 0.5, 0.1
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
_WHITE = re.compile(r"\s+")
_ASCII_COMMAS = ",،、，"


class Element:
    __slots__ = ("tag", "parent", "children", "skip", "doubt")

    def __init__(self, tag: str, parent: Element | None, skip: bool = False, doubt: float | None = None):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.doubt = doubt  # the share of the page's points from which on the element stays nevertheless
        self.children: list = []  # elements, or (text, in a link) pairs


class _TreeBuilder(HTMLParser):
    """Blocks become elements; inline tags only mark links and breaks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", None)
        self.links = 0

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def parse_marked_section(self, i, report=1):
        # As in browsers, ``<![`` opens a comment up to the next ``>``; the base class raises for unknown keywords
        # and seeks the end of known ones over any distance.
        return self.parse_bogus_comment(i, report)

    def _open(self, tag: str, skip: bool, doubt: float | None = None) -> None:
        self.at = Element(tag, self.at, skip, doubt)
        self.at.parent.children.append(self.at)
        self.links = 0

    def _close(self, tags, stops=frozenset()) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                self.links = 0
                return
            if node.tag in stops:
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links = 1
        elif tag == "br":
            self.at.children.append(("\n", False))
        elif tag in BLOCKS or tag in SKIPPED:
            if tag in CLOSES_P:
                self._close(("p",), SCOPES)
            if tag in CLOSED_BY_SAME:
                self._close(CLOSED_BY_SAME[tag], SCOPES)
            if tag in VOID:
                return
            outside = not self._inside_article()
            doubt = _doubt(tag, attrs)
            if doubt is None and outside and any(k in ("class", "id") and v and "header" in v.lower().split() for k, v in attrs):
                doubt = _MOST
            self._open(tag, tag in SKIPPED or (tag == "header" and outside) or _hidden(tag, attrs), doubt)

    def handle_startendtag(self, tag, attrs):
        # In HTML the slash of a non-void element has no meaning.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = 0
        elif tag == "br":
            self.at.children.append(("\n", False))
        elif tag in BLOCKS or tag in SKIPPED:
            self._close((tag,), frozenset() if tag != "p" else SCOPES)

    def handle_data(self, data):
        self.at.children.append((data, bool(self.links)))

    def _inside_article(self) -> bool:
        node = self.at
        while node is not None:
            if node.tag == "article":
                return True
            node = node.parent
        return False


_CONTAINERS = ("html", "body", "main", "article")


def _hidden(tag: str, attrs) -> bool:
    """Not shown, or by its role no part of the article."""
    if tag in _CONTAINERS:
        return False
    for name, value in attrs:
        shown = value or ""
        if name == "hidden" or (name == "aria-hidden" and shown == "true") or (name == "role" and shown.lower() in _ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", shown, re.I):
            return True
    return False


def _doubt(tag: str, attrs) -> float | None:
    """The share of points that saves an element whose class or id has an unwanted word."""
    if tag in _CONTAINERS:
        return None
    names = " ".join(_MODIFIED.sub("", value) for name, value in attrs if name in ("class", "id") and value)
    if _COMMENTS.search(names):
        return 1 - _REST
    return _MOST if _UNWANTED.search(names) else None


def parse(html: str) -> Element:
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def _walk(root: Element) -> list[Element]:
    """Kept elements, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Element) and not c.skip)
    return out


def _blocks(top: Element) -> list[str]:
    """Texts of the blocks below ``top`` in page order, white space made single."""
    out: list[str] = []
    piece: list[str] = []

    def end() -> None:
        text = _WHITE.sub(" ", "".join(piece)).strip()
        piece.clear()
        if text:
            out.append(text)

    stack: list = [top]
    while stack:
        item = stack.pop()
        if isinstance(item, Element):
            if item.skip:
                end()
                continue
            end()
            stack.append(None)
            stack.extend(reversed(item.children))
        elif item is None:
            end()
        else:
            piece.append(item[0])
    end()
    return out


def _settle_doubts(root: Element) -> None:
    """Cut elements with unwanted class words, except those that hold most of the page's paragraph points."""
    nodes = _walk(root)
    if all(n.doubt is None for n in nodes):
        return
    points: dict[Element, float] = {}
    for node in nodes:
        texts = [c for c in node.children if not isinstance(c, Element)]
        size = sum(len(t.strip()) for t, _ in texts)
        free = sum(len(t.strip()) for t, linked in texts if not linked)
        commas = sum(t.count(c) for t, linked in texts if not linked for c in _ASCII_COMMAS)
        points[node] = (1 + commas + min(size / 100, 3)) * free / size if size else 0.0
    for node in reversed(nodes):
        if node.parent is not None:
            points[node.parent] += points[node]
    for node in nodes:
        if node.doubt is not None and points[node] <= node.doubt * points[root]:
            node.skip = True


def main_text(html: str | None) -> str:
    """The article's blocks, joined by one space."""
    if not html:
        return ""
    root = parse(html)
    _settle_doubts(root)
    nodes = _walk(root)
    chars: dict[Element, int] = dict.fromkeys(nodes, 0)
    linked: dict[Element, int] = dict.fromkeys(nodes, 0)
    commas: dict[Element, int] = dict.fromkeys(nodes, 0)
    own: dict[Element, int] = {}
    for node in nodes:
        for child in node.children:
            if not isinstance(child, Element):
                n = len(child[0].strip())
                chars[node] += n
                commas[node] += sum(map(child[0].count, _ASCII_COMMAS))
                if child[1]:
                    linked[node] += n
        own[node] = chars[node]
    points: dict[Element, float] = dict.fromkeys(nodes, 0.0)
    for node in nodes:
        # Text that stands directly in a container counts as a paragraph of it.
        if own[node] and node.parent is not None:
            score = 1 + commas[node] + min(own[node] / 100, 3)
            at, share = (node if node.tag not in PARAGRAPHS else node.parent), 1.0
            while at is not None:
                points[at] += score * share
                at, share = at.parent, share / 2
    for node in reversed(nodes):
        if node.parent is not None:
            chars[node.parent] += chars[node]
            linked[node.parent] += linked[node]
    scored = {n: points[n] * (1 - linked[n] / chars[n]) for n in nodes if chars[n] and n.tag not in PARAGRAPHS}
    if not scored:
        return " ".join(_blocks(root))
    # The first of equals wins: `scored` is in page order.
    best = max(scored, key=lambda n: scored[n] * (1.5 if n.tag in ("article", "main") else 1))
    if best.parent is None:
        return " ".join(_blocks(best))
    enough = max(10.0, 0.2 * scored[best])
    out: list[str] = []
    for child in best.parent.children:
        if child is best:
            out += _blocks(best)
        elif isinstance(child, Element) and not child.skip and chars[child]:
            density = linked[child] / chars[child]
            paragraph = child.tag in PARAGRAPHS and (density < 0.25 and chars[child] > 80)
            if scored.get(child, 0.0) >= enough or paragraph:
                out += _blocks(child)
    return " ".join(out)


def extract_main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``text`` (empty if none) and ``n_chars`` (its code points)."""
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    rows = df.select(*kept, F.col(html).alias("_html"))
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            texts = [main_text(pages[i].as_py()) for i in range(len(pages))]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(extract, T.StructType([*rows.schema.fields[:-1], *added]))
