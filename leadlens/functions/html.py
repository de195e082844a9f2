"""The two places where HTML needs Python: entity unescape and element structure.

The first runs as an Arrow-batched pandas UDF, the second by rows, both on the narrowest columns possible.  The small parser below keeps open
elements on a stack and the text pieces of the page in one list; an element's text is a slice of that list.
"""

from __future__ import annotations

import html as _html
import re as _re
import sys
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens import lexicon as lx

# Ship this module inside the pickled functions, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
)
_TEXT = T.StringType()
LINK_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, _TEXT) for n in ("href", "raw_href", "text", "title")])
)
CONTEXT_TYPE = T.StructType([
    T.StructField("texts", T.ArrayType(_TEXT)),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("href", _TEXT), T.StructField("own", _TEXT), T.StructField("element", T.IntegerType()),
        T.StructField("matched", T.BooleanType()),
    ]))),
])
_SEAM = 400  # characters of an element in which wording that begins in the link may go on
CARD_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("name", _TEXT), T.StructField("description", _TEXT), T.StructField("hrefs", T.ArrayType(_TEXT))]
    )
)


class _Element:
    __slots__ = ("tag", "attrs", "parent", "start", "end", "index", "until")

    def __init__(self, tag, attrs, parent, start, index):
        self.tag, self.attrs, self.parent, self.start, self.index = tag, attrs, parent, start, index
        self.end = self.until = None


class _Page(HTMLParser):
    """Elements in document order, with the range of text pieces, and of later elements, that each one covers."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.pieces, self.elements = [], []
        self.stack = [_Element("", {}, None, 0, -1)]
        self.buffer = []
        self.feed(text)
        self.close()
        self._flush()
        for element in self.stack:
            self._end(element)

    def _end(self, element):
        element.end, element.until = len(self.pieces), len(self.elements)

    def _flush(self):
        piece = "".join(self.buffer).strip()
        self.buffer = []
        if piece:
            self.pieces.append(piece)

    def handle_starttag(self, tag, attrs):
        self._flush()
        values = {}
        for name, value in attrs:
            values[name] = value or ""
        element = _Element(tag, values, self.stack[-1], len(self.pieces), len(self.elements))
        self.elements.append(element)
        if tag in _VOID:
            self._end(element)
        else:
            self.stack.append(element)

    def handle_endtag(self, tag):
        self._flush()
        depth = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag), 0)
        while depth and len(self.stack) > depth:
            self._end(self.stack.pop())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_data(self, data):
        if self.stack[-1].tag not in ("script", "style", "template"):
            self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def text(self, element, separator=" "):
        return separator.join(self.pieces[element.start:element.end])


def _squeeze(text):
    return " ".join(text.split())


def _resolve(base, href):
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href


def _each_link(page_html, base):
    page = _Page(page_html or "")
    for element in page.elements:
        if element.tag == "a" and "href" in element.attrs:
            yield {
                "href": _resolve(base, element.attrs["href"]),
                "raw_href": element.attrs["href"],
                "text": _squeeze(page.text(element)),
                "title": element.attrs.get("title", ""),
            }


def _links_of(page_html, base):
    return list(_each_link(page_html, base))


def _contexts_of(page_html, wording):
    """The texts of the elements that hold links, each once, and the links: their own text, the place of their
    element's text, and whether ``wording`` is in one of both or across them.

    An element is searched once for all its links, so a page costs its size times the depth of its elements, and the
    answer is no larger, however many links share an element.
    """
    page = _Page(page_html or "")
    texts, hits, places, out = [], [], {}, []
    for element in page.elements:
        if element.tag != "a" or "href" not in element.attrs:
            continue
        at = places.setdefault(id(element.parent), len(texts))
        if at == len(texts):
            texts.append(page.text(element.parent))
            hits.append(wording.search(texts[at]) is not None)
        own = page.text(element, "")
        matched = hits[at] or wording.search(own + " " + texts[at][:_SEAM]) is not None
        out.append({"href": element.attrs["href"], "own": own, "element": at, "matched": matched})
    return {"texts": texts, "links": out}


def _each_card(page_html, base):
    page = _Page(page_html or "")
    classes = lambda e: e.attrs.get("class", "").split()
    cards = [e for e in page.elements if "server-card" in classes(e)]
    if not cards:
        cards = [e for e in page.elements if e.tag == "div" and any("server" in c for c in classes(e))]
    for card in cards:
        members = page.elements[card.index + 1:card.until]
        named = lambda mark: next((e for e in members if any(mark in c for c in classes(e))), None)
        name, description = named("server-name"), named("server-description")
        yield {
            "name": _squeeze(page.text(name)) if name else "",
            "description": _squeeze(page.text(description)) if description else "",
            "hrefs": [_resolve(base, e.attrs["href"]) for e in members if e.tag == "a" and "href" in e.attrs],
        }


def _cards_of(page_html, base):
    return list(_each_card(page_html, base))


class _LinkRows:
    """Table function: the links of a page one by one, so that no page's links are held as one value."""

    def eval(self, page_html: str, base: str):
        for pos, link in enumerate(_each_link(page_html, base)):
            yield pos, link["href"], link["raw_href"], link["text"], link["title"]


class _CardRows:
    """Table function: the server cards of a page one by one."""

    def eval(self, page_html: str, base: str):
        for pos, card in enumerate(_each_card(page_html, base)):
            yield pos, card["name"], card["description"], card["hrefs"]


link_rows = F.udtf(_LinkRows, returnType="pos int, href string, raw_href string, text string, title string", useArrow=True)
card_rows = F.udtf(_CardRows, returnType="pos int, name string, description string, hrefs array<string>", useArrow=True)


@F.pandas_udf(_TEXT)
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _html.unescape(v))


# Whole pages and all their links go by rows, a hundred at a time; an Arrow batch holds ten thousand pages, however long.
_links = F.udf(_links_of, LINK_TYPE, useArrow=False)
_cards = F.udf(_cards_of, CARD_TYPE, useArrow=False)


def unescape(text: Column) -> Column:
    """HTML entities to characters (Python, Arrow batches)."""
    return _unescape(text)


def links(page_html: Column, base_url: Column) -> Column:
    """Every ``<a href>`` of a page in document order, URL resolved against ``base_url`` (Python, by rows)."""
    return _links(page_html, base_url)


def links_in_context(page_html: Column, wording: str) -> Column:
    """Struct of ``texts``, those of the elements around links, and ``links``: every ``<a href>`` as written, its own
    text, the place of its element's text, and whether these have the wording (a pattern)."""
    pattern = _re.compile(wording)

    return F.udf(lambda page: _contexts_of(page, pattern), CONTEXT_TYPE, useArrow=False)(page_html)


def cards(page_html: Column, base_url: Column) -> Column:
    """Server cards of a directory page (Python, by rows)."""
    return _cards(page_html, base_url)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def squeeze(text: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_markup(text: Column) -> Column:
    """Tags to blanks, entities unescaped, ends trimmed (feed titles and summaries)."""
    return F.btrim(unescape(strip_tags(F.coalesce(text, F.lit("")))), F.lit(" \t\n\r\f\x0b\xa0"))


def visible_text(page_html: Column, cap: int | None = 4000) -> Column:
    """Text outside script and style, entities unescaped, white space squeezed, first ``cap`` characters."""
    body = F.regexp_replace(F.coalesce(page_html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = squeeze(unescape(strip_tags(body)))
    return text if cap is None else F.substring(text, 1, cap)


def title(page_html: Column) -> Column:
    """First ``<title>``, trimmed, at most 200 characters; NULL when there is none."""
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    found = F.btrim(F.regexp_extract(page_html, pattern, 1), F.lit(" \t\n\r\f\x0b"))
    return F.when(page_html.rlike(pattern), F.substring(found, 1, 200))


def meta_description(page_html: Column) -> Column:
    """First meta description over 20 characters, attribute order either way, at most 300 characters."""
    tries = []
    for pattern in lx.META_DESCRIPTION_PATTERNS:
        text = squeeze(unescape(F.regexp_extract(page_html, pattern, 1)))
        tries.append(F.when(F.length(text) > 20, F.substring(text, 1, 300)))
    return F.coalesce(*tries)


def description(page_html: Column) -> Column:
    """Meta description, else the first 280 characters of the visible text when it has more than 40."""
    text = visible_text(page_html, 400)
    return F.coalesce(meta_description(page_html), F.when(F.length(text) > 40, F.substring(text, 1, 280)))
