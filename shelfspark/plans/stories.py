"""Whole stories from recorded pages: listing -> book pages -> chapters in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.pages import page_parts
from shelfspark.functions.text import strip


def book_links(listings: DataFrame, base_url: str = "", **page) -> DataFrame:
    """(url) of every book that a listing page links to, once."""
    parts = page_parts("html", base_url=base_url, link_pattern=V.BOOK_LINK_PATTERN, **page)
    return listings.select(F.explode(parts["links"]).alias("url")).distinct()


def assemble_stories(listings: DataFrame, pages: DataFrame, base_url: str = "", min_chars: int = V.MIN_STORY_CHARS, **page) -> DataFrame:
    """(url, title, author, content, n_parts) of the linked books; ``pages(url, html)`` are recorded.

    A book is its own page's text and then its chapters in the order of their links, each
    chapter once; chapters that were not recorded or have no text are left out, and so are
    books below ``min_chars``. Pages meet links by two equi-joins on the address.
    """
    wanted = book_links(listings, base_url, **page)
    parts = page_parts("html", base_url=base_url, link_pattern=V.CHAPTER_LINK, **page)
    books = pages.join(wanted, "url").select("url", parts.alias("p")).select("url", "p.*")
    chapters = (books.select(F.col("url").alias("book"), F.posexplode("links").alias("place", "url"))
                .join(pages, "url").select(F.col("book").alias("url"), "place", page_parts("html", **page)["content"].alias("content")))
    pieces = books.select("url", F.lit(-1).alias("place"), "content").unionByName(chapters).filter("content <> ''")
    joined = pieces.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n")
    whole = joined.select("url", strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("content"), F.size("parts").alias("n_parts"))
    return (books.select("url", "title", "author").join(whole, "url").filter(F.length("content") >= min_chars)
            .select("url", "title", "author", "content", "n_parts"))
