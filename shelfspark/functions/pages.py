"""Title, author, body text and links of a web page.

Choosing an element by selector needs a tag-aware scan, so this is the one place where
rows pass through Python, in Arrow batches with the standard library parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import fixed_values as V

PAGE_SCHEMA = "title string, author string, content string, links array<string>"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Scan(HTMLParser):
    """Text pieces of every element that one of the selectors asks for, in one pass."""

    def __init__(self, selectors: list[str], stripped: set[str]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.stripped = selectors, stripped
        self.stack: list[tuple[str, list[str]]] = []
        self.pieces: dict[str, list[str]] = {}
        self.closed: set[str] = set()
        self.hidden = 0
        self.hrefs: list[str] = []

    def _match(self, sel: str, tag: str, attrs: dict[str, str | None]) -> bool:
        name, mark, rest = re.match(r"([a-z0-9]*)([#.]?)(.*)", sel).groups()
        if name and name != tag:
            return False
        if mark == "#":
            return attrs.get("id") == rest
        return not mark or rest in (attrs.get("class") or "").split()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href") is not None:
            self.hrefs.append(a["href"])
        if tag in _VOID:
            return
        opened = []
        for sel in self.selectors:
            if sel not in self.pieces and self._match(sel, tag, a):
                self.pieces[sel] = []
                opened.append(sel)
        self.stack.append((tag, opened))
        self.hidden += tag in self.stripped

    def handle_endtag(self, tag):
        if all(t != tag for t, _ in self.stack):
            return
        while self.stack:
            t, opened = self.stack.pop()
            self.closed.update(opened)
            self.hidden -= t in self.stripped
            if t == tag:
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.hidden:
            for sel, parts in self.pieces.items():
                if sel not in self.closed:
                    parts.append(text)


def read_page(html: str, *, content: list[str], titles: list[str], authors: list[str],
              stripped: set[str], link_pattern: str, base_url: str) -> tuple[str, str, str, list[str]]:
    scan = _Scan([*content, *titles, *authors, "title"], stripped)
    scan.feed(html or "")
    scan.close()

    def first(selectors: list[str], joiner: str, more_than: int) -> str:
        for sel in selectors:
            text = joiner.join(scan.pieces.get(sel, []))
            if len(text) > more_than:
                return text
        return ""

    wanted = re.compile(link_pattern)
    links = dict.fromkeys(urljoin(base_url, h) for h in scan.hrefs if wanted.search(h))
    author = re.sub(r"(?i)^\s*tác giả\s*:?\s*", "", first(authors, " ", 0)).strip()
    return (first([*titles, "title"], " ", 0).strip(), author,
            first(content, "\n", V.MIN_SELECTED_CHARS), list(links))


def page_parts(html: Column | str, *, base_url: str = "", content=tuple(V.CONTENT_SELECTORS),
               titles=tuple(V.TITLE_SELECTORS), authors=tuple(V.AUTHOR_SELECTORS),
               stripped=tuple(V.STRIPPED_ELEMENTS), link_pattern: str = V.BOOK_LINK_PATTERN) -> Column:
    """``struct<title, author, content, links>`` of an HTML column."""

    @F.pandas_udf(PAGE_SCHEMA)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [read_page(h, content=list(content), titles=list(titles), authors=list(authors),
                              stripped=set(stripped), link_pattern=link_pattern, base_url=base_url)
                    for h in batch]
            yield pd.DataFrame(rows, columns=["title", "author", "content", "links"])

    return parse(F.col(html) if isinstance(html, str) else html)
