"""Operator 7: main text of web pages by site template removal.

Subtrees of each page are hashed and counted over the different pages of its host; those
that recur are deleted from the whole body. What the contract names as no main text by an
element's own tag, role or class (menus, forms, scripts and so on) goes as well, for
pages of hosts with too few pages to show what recurs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import lean_batches, materialize

#: A subtree is part of a site's template if it stands on this share of the host's different pages and on so many, or on MANY_PAGES of them.
SHARE, LEAST_PAGES, MANY_PAGES = 0.01, 3, 100

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg canvas select option button audio video".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"caption"}, "tfoot": {"tr", "td", "th", "tbody"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}

#: What the contract excludes, as tags, ARIA roles, and words of class and id: menus, footers, sidebars, notices, adverts, forms and reader comments.
ASIDE = set("head nav footer aside form menu dialog fieldset".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Some of these words are common in articles too: within an article or main element those alone exclude nothing.
AMBIGUOUS = set("menu notice notices ad".split())
LABELS = set("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar notice notices cookie cookies consent ad ads advert adverts advertisement advertising sponsored comment comments".split())
#: Parts of other elements: never counted by themselves.
PIECES = set("li dt dd tr td th tbody thead tfoot caption option col colgroup".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var br wbr hr".split())
#: In the element that holds the article these are text even where they recur: only other elements can be template there.
TEXT = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figcaption figure".split()) | PIECES | INLINE
ROOTS = set("html body article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_LABEL = re.compile(r"[a-z]+|[0-9]+")
_CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Element:
    """An element; children are elements and texts (already decoded)."""

    __slots__ = ("tag", "aside", "children", "parent", "digest", "text", "counted")

    def __init__(self, tag: str, aside: int, parent: Element | None) -> None:
        self.tag, self.aside, self.parent = tag, aside, parent
        self.children: list[Element | str] = []
        self.digest, self.text, self.counted = 0, False, False


def set_aside(tag: str, attributes: str) -> int:
    """Whether an element's tag, role, class or id marks it as no main text: 2, or 1 if only an ambiguous word does and it may be text of an article."""
    if tag in ASIDE:
        return 2
    if tag in ROOTS and "comment" not in attributes.lower():
        return 0
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        kind = name.lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "role" and value in ROLES:
            return 2
        if kind in ("class", "id"):
            words = LABELS.intersection(_LABEL.findall(value))
            found = max(found, 2 if words - AMBIGUOUS else 1 if words else 0)
    return found


def parse(page: str) -> list[Element]:
    """The elements in page order, the root first; unclosed elements end with their parent or the page."""
    root = Element("", 0, None)
    order, stack = [root], [root]
    held: Counter[str] = Counter()  # open elements by tag, so that the stack is searched only for what is there

    def close(i: int) -> None:
        for e in stack[i:]:
            held[e.tag] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                stack[-1].children.append(html.unescape(token) if "&" in token else token)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if held[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in CLOSES:
            if any(held[t] > 0 for t in CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in KEEPS[tag]:
                        break
                    if stack[i].tag in CLOSES[tag]:
                        close(i)
                        break
        elif tag in BLOCK and held["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "li", "div", "article", "section", "button", "object"):
                    break
        if tag == "body" and held["head"] > 0:
            close(next(i for i in range(1, len(stack)) if stack[i].tag == "head"))
        element = Element(tag, set_aside(tag, attributes) if attributes else 2 * (tag in ASIDE), stack[-1])
        stack[-1].children.append(element)
        order.append(element)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            closed = _CLOSE[tag].search(page, at)
            at = closed.end() if closed else end
            continue
        held[tag] += 1
        stack.append(element)
    return order


def annotate(order: list[Element]) -> set[int]:
    """Set for each element its subtree's hash, whether it is text of the article, and whether it is counted.

    Hashes hold tags and texts but for white space; attributes don't count. The article is
    what stands in article and main elements and in the element around the page's longest
    text. Returns the hashes of what holds that text.
    """
    longest, home, away = 0, order[0], {id(order[0]): False}
    inside = {id(order[0]): False}
    for e in order[1:]:  # parents come first
        inside[id(e)] = inside[id(e.parent)] or e.parent.tag in ("article", "main")
        away[id(e)] = e.aside > inside[id(e)] or away[id(e.parent)]
        if not away[id(e)]:
            n = max((len(c) for c in e.children if isinstance(c, str)), default=0)
            if n > longest:
                longest, home = n, e
    holds = []
    e = home
    while e is not None:
        holds.append(e)
        e = e.parent
    while home.tag in TEXT:
        home = home.parent
    around = {id(order[0]): order[0]}
    for e in order[1:]:
        up = e.parent
        around[id(e)] = around[id(up)] if up.tag in TEXT else up
        e.text = e.tag in TEXT and (inside[id(e)] or around[id(e)] is home)
        e.counted = not (e.text or e.tag in PIECES or e.tag in INLINE or e.tag in ROOTS or e.tag in RAW or e.tag in VOID or e.tag == "head")
    for e in reversed(order):  # children come first
        h = xxhash.xxh64(e.tag)
        for child in e.children:
            h.update("\0" + " ".join(child.split()) if isinstance(child, str) else child.digest.to_bytes(9, "little", signed=True))
        e.digest = h.intdigest() - (1 << 63)
    return {e.digest for e in holds}


def main_text(order: list[Element], template: frozenset[int] | set[int], exclusions: bool = True) -> str:
    """The blocks of the whole page without its template and, unless told otherwise, without what tags and labels exclude.

    A header outside an article or main element is excluded, within one it is text; so is what
    only an ambiguous word of its class or id sets aside.
    """
    blocks: list[str] = []
    words: list[str] = []

    def end() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(text)

    stack = [(order[0], iter(order[0].children), False)]
    while stack:
        element, children, inside = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if element.tag in BLOCK:
                end()
        elif isinstance(child, str):
            words.append(child)
        elif child.digest in template and not child.text and child.tag not in ROOTS:
            continue
        elif child.tag in RAW or child.tag == "head" or exclusions and (child.aside > inside or child.tag == "header" and not inside):
            continue
        else:
            if child.tag in ("br", "td", "th"):
                words.append(" ")
            if child.tag in BLOCK:
                end()
            stack.append((child, iter(child.children), inside or child.tag in ("article", "main")))
    end()
    return "\n\n".join(blocks)


def page_text(page: str, template: set[int], exclusions: bool = True) -> str:
    """The main text of a page; where its template would leave nothing, what holds the longest text isn't template (an article on many pages)."""
    order = parse(page)
    holds = annotate(order)
    return main_text(order, template, exclusions) or main_text(order, template - holds, exclusions)


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, copy, page, subtree): the different subtrees of each page that could be template, and a null for the page itself; pages by the hash of their tree."""
    for batch in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for h, copy, page in zip(batch.column("host").to_pylist(), batch.column("copy").to_pylist(), batch.column("html"), strict=True):
            order = parse(page.as_py() or "")
            annotate(order)
            found = [*{e.digest for e in order if e.counted}, None]
            for column, values in zip(rows, ([h] * len(found), [copy] * len(found), [order[0].digest] * len(found), found), strict=True):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["host", "copy", "page", "subtree"])


def templates(pages: DataFrame) -> DataFrame:
    """(copy, template): for each different html of a host the hashes of its subtrees that recur on many different pages of the host.

    Pages with the same tree count once, among those that hold a subtree and among all. The
    list of a page is no longer than the page, however many templates the host has.
    """
    seen = materialize(pages.select("host", "copy", "html").mapInArrow(page_subtrees, "host long, copy long, page long, subtree long"))
    counts = seen.groupBy("host", "subtree", "page").agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counts = materialize(counts.where((F.col("n") >= LEAST_PAGES) | F.col("subtree").isNull()))
    sizes = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    many = counts.where("subtree is not null").join(sizes, "host").where((F.col("n") >= SHARE * F.col("pages")) | (F.col("n") >= MANY_PAGES))
    many = materialize(many.select("host", "subtree"))
    return seen.join(many, ["host", "subtree"]).groupBy("copy").agg(F.collect_set("subtree").alias("template"))


def extract_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, template in zip(batch.column("html"), batch.column("template"), strict=True):
            texts.append(page_text(page.as_py() or "", set(template.as_py() or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Null html counts as empty and gives an empty text; pages without a URL share the empty
    host; scripts, styles, frames, drawings, form fields, and audio and video with what stands in
    for them give no text, formulas and the text that stands in for objects do; broken markup is read as far as it goes, however deep. Repeated rows and ids give
    a row each and count once as pages; an empty table gives no rows; other columns are ignored.
    """
    lean_batches(pages.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select("page_id", "url", text.alias("html"), F.xxhash64(host(F.col("url"))).alias("host")).withColumn("copy", F.xxhash64("host", "html"))
    # Both sides are as large as the pages: a merge at every size, whose hot copies Spark can split.
    found = materialize(templates(known)).hint("merge")
    return known.join(found, "copy", "left").select("page_id", "url", "html", "template").mapInArrow(extract_text, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
