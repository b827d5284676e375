"""HTML functions: small per-page helpers on the standard parser, used through Arrow-batched functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Subtrees without visible text, elements whose text counts, and elements without content.
DROPPED = {"script", "style", "noscript", "svg", "footer", "nav", "form", "header"}
KEPT = {"h1", "h2", "h3", "p", "li", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Of the elements that are open around a text, so many get it, the innermost ones. Only pages with unclosed tags nest deeper;
#: without a bound, their text grows with the square of the page.
REPEATS = 64


class _Page(HTMLParser):
    """One pass; a piece of text costs ``REPEATS`` appends at most, a tag what it opens or closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # tag, and whether it is in ``kept``
        self.count: Counter[str] = Counter()  # of the open tags
        self.dropped = 0  # open tags whose text is not shown
        self.kept: list[list[str]] = []  # texts of the open elements that count, outermost first
        self.texts: list[list[str]] = []
        self.title, self.snippet, self.links = None, None, []
        self.paragraph: list[str] | None = None
        self.anchor: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            self.anchor = [href, []] if href is not None else None
        if tag == "p" and self.snippet is None and self.paragraph is None:
            self.paragraph = []
        if tag in VOID:
            return
        keep = tag in KEPT and not self.dropped
        self.open.append((tag, keep))
        self.count[tag] += 1
        self.dropped += tag in DROPPED
        if keep:
            self.kept.append([])
            self.texts.append(self.kept[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor is not None:
            self.links.append((self.anchor[0], " ".join(t for x in self.anchor[1] if (t := x.strip()))))
            self.anchor = None
        if tag == "p" and self.paragraph is not None and self.snippet is None:
            self.snippet = " ".join(" ".join(self.paragraph).split())[:300]
        while self.count[tag]:
            last, keep = self.open.pop()
            self.count[last] -= 1
            self.dropped -= last in DROPPED
            if keep:
                self.kept.pop()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.title is None and self.open and self.open[-1][0] == "title":
            self.title = data.strip()
        if self.anchor is not None:
            self.anchor[1].append(data)
        if self.paragraph is not None and self.snippet is None:
            self.paragraph.append(data.strip())
        if not self.dropped and (shown := data.strip()):
            for t in self.kept[-REPEATS:]:
                t.append(shown)


def parse_page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    if p.snippet is None and p.paragraph is not None:
        p.snippet = " ".join(" ".join(p.paragraph).split())[:300]
    return p


def page_visible_text(html: str | None) -> str:
    return shown_text(parse_page(html))


def shown_text(page: _Page) -> str:
    parts = (" ".join(" ".join(t).split()) for t in page.texts)
    return re.sub(r"\s+", " ", " ".join(x for x in parts if x)).strip()


#: So many rows of a batch stand as Python objects at a time.
ROWS = 128


def by_row(f: Callable[[str | None], object], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """``f`` of each text; beside a batch and its results, only ``ROWS`` rows are held."""
    parts = [pa.array([f(t) for t in texts.slice(i, ROWS).to_pylist()], kind) for i in range(0, len(texts), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _fields(*names: str) -> tuple[T.StructType, pa.DataType]:
    return T.StructType([T.StructField(n, T.StringType()) for n in names]), pa.struct([(n, pa.string()) for n in names])


_META, _META_ARROW = _fields("title", "snippet")
_VIEW, _VIEW_ARROW = _fields("text", "title", "snippet")


def _meta(html: str | None) -> dict[str, str]:
    p = parse_page(html)
    return {"title": p.title or "", "snippet": p.snippet or ""}


def _view(html: str | None) -> dict[str, str]:
    p = parse_page(html)
    return {"text": shown_text(p), "title": p.title or "", "snippet": p.snippet or ""}


@F.arrow_udf(T.StringType())
def _visible_text(html: pa.Array) -> pa.Array:
    return by_row(page_visible_text, html, pa.string())


@F.arrow_udf(_META)
def _page_meta(html: pa.Array) -> pa.Array:
    return by_row(_meta, html, _META_ARROW)


@F.arrow_udf(_VIEW)
def _page_view(html: pa.Array) -> pa.Array:
    return by_row(_view, html, _VIEW_ARROW)


def page_view(html: Column) -> Column:
    """struct(text, title, snippet): ``visible_text`` and ``page_meta`` of one parse."""
    return _page_view(html)


def visible_text(html: Column) -> Column:
    """Text of headings, paragraphs, list items and cells in order, outside dropped subtrees; nested ones repeat (``REPEATS``)."""
    return _visible_text(html)


def page_meta(html: Column) -> Column:
    """struct(title, snippet): the title, and the first 300 characters of the first paragraph."""
    return _page_meta(html)


def links_of(url: str | None, html: str | None) -> Iterator[tuple[int, str, str, str, str]]:
    """(position, href, anchor, title, snippet) of a page's links; hrefs are resolved against the page and have no fragment."""
    p = parse_page(html)
    for i, (href, anchor) in enumerate(p.links):
        try:
            yield i, urljoin(url or "", href.split("#")[0]), anchor, p.title or "", p.snippet or ""
        except ValueError:  # a malformed address
            continue


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link of ``pages`` (url, html): from_url, position, href (resolved, without fragment), anchor, title, snippet."""

    names = ["from_url", "position", "href", "anchor", "title", "snippet"]
    kind = pa.schema([(n, pa.int32() if n == "position" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS).to_pydict()
                rows = [(url, *link) for url, html in zip(part["url"], part["html"], strict=True) for link in links_of(url, html)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kind)

    return pages.select("url", "html").mapInArrow(run, "from_url string, position int, href string, anchor string, title string, snippet string")


class PageLinks:
    """A table function for SQL: the links of one page."""

    def eval(self, url: str, html: str):
        yield from links_of(url, html)


def register_page_links(spark: SparkSession, name: str = "page_links") -> None:
    """Make ``LATERAL page_links(url, html)`` known to the session's SQL."""
    spark.udtf.register(name, F.udtf(PageLinks, returnType="position int, href string, anchor string, title string, snippet string"))
