"""Main text of web pages by composite text density.

Every node of the parsed tree gets a density: its characters for each of its tags,
lessened by its link characters and link tags (composite text density). Text of menus, footers,
forms and the like counts as link text: elements, roles and names are features of the density.
The node with the greatest sum of its children's densities is the heart of the article; from it on
a single child that holds most of the sum is followed. The article is the heart and, on the path to the body, what
reaches the least density of the path and a share of the heart's sum, and paragraphs, headings, lists and sections
beside it. Where a page has an ``article`` or ``main`` element, text outside it weighs as little as links, and all within it
but menus, notices and the like belongs to it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw content, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements of text: beside the heart of an article, they belong to it.
TEXTUAL = HEADINGS | frozenset("p ul ol dl blockquote pre table figure section details hgroup address center".split())
#: Elements whose names say nothing, because they are parts of a text.
PARTS = HEADINGS | frozenset("p blockquote pre li dd dt td th tr tbody figure figcaption caption summary".split())
#: Elements and roles that are no part of an article.
ASIDE = frozenset("nav footer aside form button dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Names of such elements: as whole names and as words of longer ones; those that also name parts of articles
#: count only with many links, or as whole names outside of articles.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsors sponsored".split())
COMMENTS = frozenset("comment comments commentlist commentform respond replies disqus".split())
ASIDE_NAMES = ADVERTS | COMMENTS | frozenset("breadcrumb breadcrumbs cookie cookies consent footer gdpr modal nav navbar navigation newsletter pagination pager popup sidebar subscribe".split())
EITHER_NAMES = frozenset("menu notice notices promo promos promotion related share sharing skip social toolbar widget widgets".split())
#: Whole names of readers' comments and adverts of several words.
COMPOUNDS = frozenset("comment-list comments-list comments-area comments-section comment-section reader-comments user-comments ad-banner ad-container ad-slot ad-wrapper cookie-notice cookie-banner cookie-consent newsletter-signup".split())
TOP_NAMES = frozenset("banner header masthead".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: The parts of a tag: its name, and an attribute without its quoted value.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(\s*/?>)?")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(?=[\"'])|([^\s>]*)))?")
_GAP = re.compile(r"\s+")
#: The least divisor, for pages without links.
LEAST_LOG = 0.1
#: A child with this share of a sum of densities is followed.
MOST = 0.6
#: What else of the page is as dense and has this share of the heart's sum belongs to the article.
PART = 0.25
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NOWHERE = {"p": None, "li": None, "dd": None, "td": None, "tr": None, "tbody": None}


class Node:
    __slots__ = ("attributes", "block_depth", "chars", "children", "density", "depth", "in_article", "link_chars", "links", "noise", "parent", "scope", "tag", "tags", "total", "whole")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.total = 0.0
        self.noise = False
        self.whole = tag in ("article", "main", "h1")
        self.depth = parent.depth + 1 if parent else 0
        self.block_depth = self.depth if tag in BLOCK or not parent else parent.block_depth
        self.in_article = bool(parent) and (parent.in_article or parent.is_core())
        self.scope = _scope(tag, self, parent.scope if parent else _NOWHERE)

    def is_core(self) -> bool:
        return self.tag in ("article", "main") or self.attributes.get("role", "").lower() in ("article", "main")

    def whole_names(self) -> set[str]:
        return {x.lower() for k in ("class", "id") for x in self.attributes.get(k, "").split()}

    def names(self) -> set[str]:
        """The words of the names."""
        return {x.lower() for k in ("class", "id") for x in _NAME.findall(self.attributes.get(k, ""))}


def _scope(tag: str, node: Node, of: dict) -> dict:
    """The open elements that a later tag may close, as seen from within ``node``."""
    if tag == "p":
        return of | {"p": node}
    if tag == "li":
        return of | {"li": node, "p": None}
    if tag in ("dt", "dd"):
        return of | {"dd": node, "p": None}
    if tag in ("td", "th"):
        return _NOWHERE | {"td": node, "tr": of["tr"], "tbody": of["tbody"]}
    if tag == "tr":
        return of | {"tr": node, "td": None}
    if tag in ("thead", "tbody", "tfoot"):
        return of | {"tbody": node, "tr": None, "td": None}
    if tag == "table":
        return _NOWHERE
    if tag in ("ul", "ol", "menu", "dl"):
        return of | {"li": None, "dd": None, "p": None}
    return of | {"p": None} if tag in BLOCK and of["p"] else of


class Tags:
    """The tags of a page, each read once; no search is begun again for what isn't there."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()
        self.found: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def behind_comment(self, at: int) -> int:
        """The place behind the comment at ``at``, which ends with ``-->`` or ``--!>``, or with the page."""
        for empty in ("<!-->", "<!--->"):
            if self.page.startswith(empty, at):
                return at + len(empty)
        ends = [(end, len(mark)) for mark in ("-->", "--!>") if (end := self.ahead(mark, at + 4)) >= 0]
        end, size = min(ends, default=(len(self.page), 0))
        return end + size

    def ahead(self, what: str, at: int) -> int:
        """As :meth:`find`, but what was found before and still lies ahead isn't searched for again."""
        if (have := self.found.get(what, -1)) < at:
            have = self.found[what] = self.find(what, at)
        return have

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from ``at`` on, the place behind the tag's ``>`` and whether it ends with ``/``."""
        page, found = self.page, {}
        while (m := _ATTRIBUTE.match(page, at)) is not None:
            name, at = m[1].lower(), m.end()
            value = m[2] or ""
            if m[2] is None and at < len(page) and page[at] in "\"'":
                end = self.find(page[at], at + 1)
                value = page[at + 1 : end] if end >= 0 else ""
                after = page[end + 1 : end + 2]
                if end < 0 or ("<" in value and ">" in value and after not in (">", "/", "") and not after.isspace()):
                    end = page.find(">", at)  # the quote isn't closed: the tag ends at the next >
                    value, at = page[at + 1 : end], end
                    found.setdefault(name, value)
                    break
                at = end + 1
            found.setdefault(name, value)
        end = page.find(">", at)
        return found, (end + 1 if end >= 0 else len(page)), end > 0 and page[end - 1] == "/"


def parse(page: str) -> Node:
    """The tree of a page; missing ends and strays are repaired, raw elements and comments left out."""
    root = Node("html", None, {})
    tags, here, opened = Tags(page), root, {}
    at = text_from = 0

    def text_to(end: int) -> None:
        if end > text_from:
            here.children.append(page[text_from:end])

    def close(last: Node, node: Node) -> Node:
        """The parent of ``node``, which is closed with all that is open within it."""
        while True:
            if opened.get(last.tag):
                opened[last.tag].pop()
            if last is node:
                return node.parent
            last = last.parent

    while True:
        at = tags.find("<", at)
        if at < 0:
            text_to(len(page))
            return root
        if page.startswith("<!--", at):
            text_to(at)
            at = text_from = tags.behind_comment(at)
            continue
        m = _TAG.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?") or (page[at + 1 : at + 2] == "/" and at + 2 < len(page)):
                text_to(at)
                end = tags.find(">", at)
                at = text_from = end + 1 if end >= 0 else len(page)
            else:
                at += 1
            continue
        text_to(at)
        if tags.find(">", at) < 0:  # a tag that never ends takes the rest of the page with it
            return root
        tag = m[2].lower()
        if m[3]:
            attributes, at, empty = {}, m.end(), m[3].endswith("/>")
        else:
            attributes, at, empty = tags.attributes(m.end())
        text_from = at
        if m[1]:
            depths = opened.get(tag)
            if depths and tag not in ("html", "body"):
                if tag in BLOCK or tag == "a" or depths[-1].depth > here.block_depth:
                    here = close(here, depths[-1])
            elif tag == "br":
                here.children.append(Node("br", here, {}))
            continue
        if tag in RAW:
            if not (empty and tag in ("svg", "math")):
                end = _ENDS[tag].search(page, at) if f"</{tag}" not in tags.missing else None
                if end is None:
                    tags.missing.add(f"</{tag}")
                at = text_from = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            continue
        if tag in ("html", "head") or (tag == "body" and opened.get("body")):
            continue
        if tag in BLOCK:
            scope = here.scope
            ends = [scope["p"]]
            if tag == "li":
                ends.append(scope["li"])
            elif tag in ("dt", "dd"):
                ends.append(scope["dd"])
            elif tag in ("td", "th"):
                ends.append(scope["td"])
            elif tag == "tr":
                ends += [scope["td"], scope["tr"]]
            elif tag in ("thead", "tbody", "tfoot"):
                ends += [scope["td"], scope["tr"], scope["tbody"]]
            ends = [x for x in ends if x is not None]
            if ends:
                here = close(here, min(ends, key=lambda x: x.depth))
        node = Node(tag, here, attributes)
        here.children.append(node)
        if tag not in VOID and not (empty and tag not in BLOCK and tag != "a"):
            here = node
            opened.setdefault(tag, []).append(node)


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    return order


def _is_aside(node: Node, of_all: float) -> bool:
    """Whether elements, roles or names speak against a node; ``of_all`` is its share of the page's text."""
    tag, given = node.tag, node.attributes
    if tag in ("body", "main", "html"):
        return False
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        return True
    wraps = node.whole and of_all > 0.5  # most of the page and its article or title
    if given.get("role", "").lower() in ASIDE_ROLES or (tag in ASIDE and not (tag == "form" and wraps)):
        return True
    whole, names = node.whole_names(), node.names()
    if tag == "article":
        return bool(names & COMMENTS) and not wraps
    if (tag == "header" or names & TOP_NAMES) and tag not in PARTS and not wraps:
        # the header of an article holds its title; that of a page stands in the body
        if not (node.in_article and tag == "header") and not (node.whole and (node.in_article or node.parent.tag != "body")):
            return True
    if tag in PARTS:
        return bool(names & ADVERTS)
    if wraps or (node.in_article and node.whole):
        return False
    many_links = 2 * node.link_chars > node.chars
    if node.in_article:  # one word of a longer name says nothing here
        return bool(whole & (ASIDE_NAMES | COMPOUNDS)) or (many_links and bool(whole & EITHER_NAMES))
    return bool(names & ASIDE_NAMES or whole & (COMPOUNDS | EITHER_NAMES)) or (many_links and bool(names & EITHER_NAMES))


def measure(body: Node, hints: bool = True) -> list[Node]:
    """All nodes, parents first, with composite text densities and the sums of their children's."""
    order = _order(body)
    own = [sum(len(_GAP.sub(" ", c).strip()) for c in node.children if isinstance(c, str)) for node in order]
    for node, n in zip(order, own, strict=True):
        node.chars = n
    for node in reversed(order):
        if node is not body:
            node.parent.chars += node.chars
            node.parent.whole = node.parent.whole or node.whole
    linked: dict[int, bool] = {}
    for node, n in zip(order, own, strict=True):
        linked[id(node)] = node.tag == "a" or (node is not body and linked[id(node.parent)])
        node.link_chars = n if linked[id(node)] else 0
    for node in reversed(order):
        if node is not body:
            node.parent.link_chars += node.link_chars
    for node in order:
        node.noise = (node is not body and node.parent.noise) or (hints and _is_aside(node, node.chars / max(1, body.chars)))
    cored = hints and any(node.is_core() and not node.noise and node.chars for node in order)
    for node, n in zip(order, own, strict=True):
        # where a page has an article, what stands outside weighs as little as links
        linked[id(node)] = node.noise or node.tag == "a" or (node is not body and linked[id(node.parent)])
        node.link_chars = n if linked[id(node)] or (cored and not (node.in_article or node.is_core())) else 0
    for node in reversed(order):
        if node is not body:
            node.parent.link_chars += node.link_chars
            node.parent.tags += node.tags + 1
            node.parent.links += node.links + (node.tag == "a" or node.noise)
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, bound, links = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.links)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * max(0.0, math.log(c / bound * t / links)) / max(LEAST_LOG, math.log(base))
    for node in order:
        if node is not body and node.tag in BLOCK:  # the parts of a paragraph don't compete with it
            node.parent.total += node.density
    return order


def _heart(order: list[Node]) -> Node:
    """The node of the greatest sum of densities, or the only child that holds most of it."""
    heart = max(order, key=lambda n: n.total)
    while True:
        follow = next((c for c in heart.children if not isinstance(c, str) and c.tag in BLOCK and c.density > MOST * heart.total), None)
        if follow is None or not heart.total:
            return heart
        heart = follow


def main_nodes(root: Node, hints: bool = True) -> list[Node | str]:
    """The parts of the page that are its article, in page order; noise within them is left to :func:`blocks`."""
    body = next((c for c in root.children if not isinstance(c, str) and c.tag == "body"), None)
    if body is None or any(c is not body for c in root.children if (c.strip() if isinstance(c, str) else c.tag not in VOID)):
        body = root
    heart = _heart(measure(body, hints))
    path = [heart]
    while path[-1] is not body:
        path.append(path[-1].parent)
    if heart is body:
        return [body]
    least = min(n.density for n in path[:-1])
    # what stands before and behind the path at each level, from the body inwards
    before: list[Node | str] = []
    behind: list[list[Node | str]] = []
    for level in range(len(path) - 1, 0, -1):
        parent, down, after = path[level], path[level - 1], False
        later: list[Node | str] = []
        for c in parent.children:
            if c is down:
                after = True
                continue
            if not isinstance(c, str):
                within = hints and (parent.in_article or parent.is_core())  # of an article, all but noise
                title = (c.tag in HEADINGS or c.tag == "header") and not heart.whole
                beside = (parent is not body or down.tag in TEXTUAL) and (c.tag in TEXTUAL or c.tag not in BLOCK)
                if not c.chars or c.noise or not (within or title or beside or (c.density >= least and max(c.total, c.density) >= PART * heart.total)):
                    continue
                if not within and 3 * c.link_chars > 2 * c.chars and c.tag in BLOCK:
                    continue
            (later if after else before).append(c)
        behind.append(later)
    return [*before, heart, *(c for later in reversed(behind) for c in later)]


def blocks(nodes: list[Node | str]) -> list[str]:
    """The texts of the blocks of ``nodes`` in page order without noise, white space within each as one space."""
    out, now = [], []

    def flush() -> None:
        text = _GAP.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(entities.unescape(x))
        elif x.tag == "br":
            now.append(" ")
        elif not x.noise:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None, hints: bool = True) -> str:
    """The article of ``page``; empty without one (or without a page).

    Without ``hints`` the density alone decides, whatever elements, roles and names say.
    A page of any length or depth is read in linear time.
    """
    if not page:
        return ""
    return "\n\n".join(blocks(main_nodes(parse(page), hints)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, a row for each page (null html: empty text).

    Null ids and urls and repeated rows are kept as they are; other columns aren't read.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
