"""The main text of web pages by tag-path ratios.

A page is read once, left to right, into text runs, each with the path of block elements above it.
Length and punctuation are summed up per path and divided by the path's runs; both ratios together are
the path's score. The scores, in page order, are smoothed over neighbouring runs, and runs above a
threshold are content. Elements that are none of an article by their tag, or by the words of their class,
id or role, are then left out, unless they hold an article's or nearly all of the page's content; after
that the paths are scored anew. The article elements that hold a good part of the content are the article,
or if all of them hold less than half of it, the element that holds nearly all. Short paragraphs and headings in it belong to it; paths in it
that are mostly links and no content do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tollbridge.llm.base import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？…]")

RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
#: Those of them that last to the page's end if nothing closes them; the others are then passed over.
ENDLESS = frozenset("script style textarea title xmp".split())
#: Elements that are no part of an article.
DROPPED = frozenset("head nav header footer aside form button select option datalist fieldset dialog menu object applet".split())
#: Words of class, id or role with the same meaning; those in the second set don't hold inside an article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion promoted nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar complementary contentinfo widget footer cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond discussion form search searchbox pagination pager toolbar copyright "
    "disclaimer skip outbrain taboola teaser teasers".split()
)
#: A name after one of these tells what the page has beside the element: with-sidebar, no-menu.
STATES = frozenset("has no not with without hide show is".split())
#: Words that only say what kind of box an element is: the word before them tells what is in it.
BOXES = frozenset(
    "area bar block body bottom box btn button buttons card cell col column container content copy container footer group grid heading "
    "icon icons image img inner item items label left line link links list main message outer page panel post posts primary right "
    "row secondary section site slot stack strip text title top unit view wrap wrapper zone".split()
) - {"footer"}
#: What readers say is left out however much of the page it is.
READERS = frozenset("comment comments disqus reply replies respond discussion".split())
DROPPED_OUTSIDE = frozenset("header masthead topbar top head banner hero".split())
#: A start tag closes these open elements first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
KEEPS_OPEN = frozenset("table ul ol dl article section main div body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
#: Part of the content that an element holds for the search to go on inside it, that a further article needs,
#: and that all articles hold, or else they are only teasers of others.
NEARLY_ALL, GOOD_PART, MOST_PART = 0.9, 0.2, 0.5
#: Share of a path's text in links from which on it needs content to stay.
LINKED_PART = 0.5
#: Runs are content from this part of the scores' standard deviation on, or of the highest score if that is less.
DEVIATION, OF_HIGHEST = 0.8, 0.3


class Element:
    __slots__ = ("tag", "parent", "path", "hidden", "marked", "firm", "readers", "main", "dropped", "article", "content", "closed", "inside")

    def __init__(self, tag: str, parent: Element | None, name: str = ""):
        self.tag, self.parent = tag, parent
        self.path = hash((parent.path, tag, name)) if parent else 0
        self.hidden = parent.hidden if parent else False
        self.marked = self.firm = self.readers = self.main = self.dropped = self.closed = self.inside = False
        self.article: Element | None = parent.article if parent else None
        self.content = 0.0


def _told(value: str) -> set[str]:
    """What the names in a class, id or role tell of an element: each name's last word that isn't a kind of box."""
    told = set()
    for name in value.split():
        words = [x.lower() for x in _NAME.findall(name)]
        words = [x for before, x in zip(["", *words], words) if before not in STATES]
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        told.update(words[-1:])
    return told


def _names(attributes: str) -> tuple[str, set[str], bool, bool]:
    """The class as it stands, what class, id and role tell, whether it is hidden, whether it is the main part."""
    shown, told, hidden, main = "", set(), False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            told |= _told(value)
            main = main or (name == "role" and value.lower() in ("main", "article"))
            if name == "class":
                shown = "." + value
        elif name == "itemprop":
            main = main or value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return shown, told, hidden, main


def _open(tag: str, attributes: str, parent: Element) -> Element:
    shown, told, hidden, main = _names(attributes) if attributes and attributes != "/" else ("", set(), False, False)
    inside = parent.article is not None
    element = Element(tag, parent, shown)
    element.hidden = parent.hidden or hidden
    element.main = tag in ARTICLES or main
    if element.main:
        element.marked = bool(told & (READERS | {"related", "promo", "ad", "teaser"}))
        element.article = element.article or element
    elif tag not in ("html", "body"):
        by_tag = tag in DROPPED and not (tag == "header" and inside)
        element.marked = by_tag or bool(told & DROPPED_NAMES or (not inside and told & DROPPED_OUTSIDE))
        element.firm = by_tag and tag != "form"
    element.readers = element.marked and bool(told & READERS)
    return element


def read_runs(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The block elements as they open, and the text runs that are shown, in page order: each with its
    element, its text and how many characters of it are in links."""
    root = Element("", None)
    elements, stack, runs, text = [root], [root], [], []
    open_tags: dict[str, int] = {}
    inline: list[tuple[str, Element]] = []  # inline elements that are left out, with the block they stand in
    at, end, linked, in_link = 0, len(html), 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                runs.append((stack[-1], whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        for element in stack[depth:]:
            element.closed = True
            open_tags[element.tag] -= 1
        del stack[depth:]

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].hidden and not inline:
            text.append(html[at:stop])
            linked += (stop - at) * in_link
        if not m:
            break
        at = m.end()
        closing, tag, attributes, closed = m.groups()
        if tag is None or not closed:
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            if closing:
                if inline and inline[-1][0] == tag:
                    inline.pop()
            elif attributes and attributes.strip() not in ("", "/"):
                _, told, hidden, _ = _names(attributes)
                if hidden or told & DROPPED_NAMES or inline and inline[-1][0] == tag:
                    inline.append((tag, stack[-1]))
            elif inline and inline[-1][0] == tag:
                inline.append((tag, stack[-1]))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        flush()
        if closing:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
        elif tag in RAW:
            found = None if tag == "svg" and attributes.endswith("/") else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            if found or tag in ENDLESS:
                at = found.end() if found else end
        else:
            if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
                close(len(stack) - 1)
            closes = CLOSES.get(tag, ())
            for depth in range(len(stack) - 1, 0, -1) if any(map(open_tags.get, closes)) else ():
                if stack[depth].tag in closes:
                    close(depth)
                    break
                if stack[depth].tag in KEEPS_OPEN:
                    break
            element = _open(tag, attributes, stack[-1])
            elements.append(element)
            stack.append(element)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        inline = [(t, e) for t, e in inline if not e.closed] if inline else inline
    flush()
    return elements, runs


def content_flags(runs: list[tuple[Element, str, int]]) -> list[bool]:
    """Whether each run is content by the ratios of its path."""
    totals: dict[int, list[float]] = {}
    for element, text, _ in runs:
        own = totals.setdefault(element.path, [0, 0, 0])
        own[0] += len(text)
        own[1] += len(_PUNCTUATION.findall(text))
        own[2] += 1
    score = {path: (length / n) * (1 + marks) / n for path, (length, marks, n) in totals.items()}
    raw = [score[element.path] for element, _, _ in runs]
    smooth = [(a + 2 * b + c) / 4 for a, b, c in zip([raw[0], *raw], raw, [*raw[1:], raw[-1]])]
    mean = sum(smooth) / len(smooth)
    deviation = (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5
    threshold = min(DEVIATION * deviation, OF_HIGHEST * max(smooth))
    return [x >= threshold for x in smooth]


def _sum_up(elements: list[Element], runs: list[tuple[Element, str, int]], flags: list[bool]) -> None:
    """Each element's ``content``: the characters of content in it and in what it holds."""
    for element in elements:
        element.content = 0.0
    for (element, text, _), good in zip(runs, flags):
        element.content += len(text) * good
    for element in reversed(elements[1:]):
        element.parent.content += element.content


def _drop(elements: list[Element]) -> None:
    """Leave out marked elements, but for those that hold a main element with half of their content, or on a
    page without one, and unless the tag says what they are, nearly all of its content. What readers say is
    left out in any case."""
    most: dict[Element, float] = {}
    plain = not any(e.main and not e.marked for e in elements)
    for element in reversed(elements[1:]):
        inner = max(most.get(element, 0.0), element.content if element.main and not element.marked else 0.0)
        most[element.parent] = max(most.get(element.parent, 0.0), inner)
    whole = elements[0].content
    for element in elements[1:]:
        holds = 2 * most.get(element, 0.0) >= element.content or plain and not element.firm and element.content >= NEARLY_ALL * whole
        element.dropped = element.parent.dropped or element.marked and (element.readers or not (element.content and holds))


def extract(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    elements, runs = read_runs(html or "")
    if not runs:
        return ""
    _sum_up(elements, runs, content_flags(runs))
    _drop(elements)
    runs = [r for r in runs if not r[0].dropped]
    if not runs:
        return ""
    flags = content_flags(runs)
    _sum_up(elements, runs, flags)
    articles = {e.article for e, _, _ in runs if e.article is not None}
    most = max((a.content for a in articles), default=0.0)
    chosen = {a for a in articles if a.content >= GOOD_PART * most}
    if sum(a.content for a in chosen) < MOST_PART * elements[0].content or not elements[0].content:
        children: dict[Element, list[Element]] = {}
        for element in elements[1:]:
            children.setdefault(element.parent, []).append(element)
        top = elements[0]
        while inner := [c for c in children.get(top, ()) if c.content >= NEARLY_ALL * top.content and c in children]:
            top = inner[0]
        chosen = {top}
    for element in elements:
        element.inside = element in chosen or element.parent is not None and element.parent.inside
    links: dict[int, list[int]] = {}
    for (element, text, linked), good in zip(runs, flags):
        own = links.setdefault(element.path, [0, 0, 0])
        own[0] += len(text)
        own[1] += linked
        own[2] += good
    listed = {path for path, (length, linked, good) in links.items() if not good and linked >= LINKED_PART * length}
    return " ".join(text for element, text, _ in runs if element.inside and element.path not in listed)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty page, and one without an article, has an empty text. Repeated rows come out each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
