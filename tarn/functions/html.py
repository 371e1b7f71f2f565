"""HTML extraction in Arrow batches: title, visible text, links and the canonical link. No built-in parses HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = {"script", "style", "noscript"}
_HEAD = {"head", "title", "base", "link", "meta", "script", "style", "noscript", "template", "html"}
_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
_PAGE = T.StructType([*[T.StructField(c, T.StringType()) for c in ("title", "text", "canonical")], T.StructField("links", T.ArrayType(_LINK))])


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.title: list[str] | None = None
        self.in_title = self.title_done = False
        self.dropped: list[str] = []
        self.in_body = False
        self.run: list[str] = []
        self.parts: list[str] = []
        self.links: list[dict] = []
        self.open_link: list[str] | None = None
        self.canonical: str | None = None
        self.canonical_over = False

    def resolved(self, href: str) -> str | None:
        try:
            url = urljoin(self.base, href)
            parts = urlsplit(url)
        except ValueError:
            return None
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return None
        return url if parts.path else url.replace(parts.netloc, parts.netloc + "/", 1)

    def flush(self) -> None:
        text = "".join(self.run).strip()
        if text:
            self.parts.append(text)
        self.run = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        named = dict(reversed(attrs))
        if tag == "title" and not self.in_body and self.title is None:
            self.title, self.in_title = [], True
        if tag == "body" or tag not in _HEAD and tag != "body":
            self.in_body = True
        if tag in DROPPED:
            self.dropped.append(tag)
        if tag == "a":
            self.close_link()
            href = (named.get("href") or "").strip()
            if "href" in named and href and not href.startswith("#") and not href.lower().startswith(("mailto:", "javascript:", "tel:")):
                url = self.resolved(href)
                if url:
                    self.open_link = []
                    self.links.append({"url": url, "text": self.open_link})
        if tag == "link" and not self.canonical_over and "rel" in named and "href" in named:
            href = (named["href"] or "").strip()
            if "canonical" in (named["rel"] or "").lower().split() and href:
                url = self.resolved(href)
                if url:
                    self.canonical, self.canonical_over = url, True

    def close_link(self) -> None:
        self.open_link = None

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag == "title":
            self.in_title = False
        elif tag in DROPPED and tag in self.dropped:
            del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(tag) :]
        elif tag == "a":
            self.close_link()
        elif tag == "head":
            self.in_body = True

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        if self.open_link is not None:
            self.open_link.append(data)
        if self.in_title:
            self.title.append(data)
        elif not self.dropped and (self.in_body or data.strip()):
            self.in_body = True
            self.run.append(data)


def parse(html: str | None, base: str | None) -> dict | None:
    """title, text, canonical and links of a page; null for a null page. Links need a base to resolve against."""
    if html is None:
        return None
    p = _Page(base or "")
    p.feed(html)
    p.close()
    p.flush()
    return {"title": "".join(p.title or []).strip(), "text": " ".join(p.parts), "canonical": p.canonical, "links": [{"url": x["url"], "text": "".join(x["text"]).strip()} for x in p.links]}


@F.pandas_udf(_PAGE)
def _page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, base in batches:
        yield pd.DataFrame([parse(h, b) or {"title": None, "text": None, "canonical": None, "links": None} for h, b in zip(html, base, strict=True)], columns=["title", "text", "canonical", "links"])


def parsed_page(html: Column | str, url: Column | str) -> Column:
    """struct(title, text, canonical, links) of each page. Extract once and keep it: filters do not pass through."""
    return _page(html, url)


def raw_title(html: Column | str) -> Column:
    """The first title element's text, trimmed, entities as they stand: a built-in for when they don't matter."""
    html = F.col(html) if isinstance(html, str) else html
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
