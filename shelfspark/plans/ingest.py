"""Raw records -> cleaned records, one plan per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.extract import classify_by_category, keep_meaningful_categories, on_topic
from shelfspark.functions.ids import archive_id
from shelfspark.functions.text import (
    book_card, clean_article, clean_book_text, lead_lines, nonblank, prefix, strip, word_count)
from shelfspark.session import explode_once
from shelfspark.operators.keyed import keep_first, keep_longest, title_author_key


def cleaned_texts(df: DataFrame, text: str, *keep: str, min_chars: int = V.MIN_CLEAN_CHARS) -> DataFrame:
    """Cleaned article texts of at least ``min_chars`` characters; each text is cleaned once."""
    long = F.filter(F.array(clean_article(text)), lambda c: F.length(c) >= min_chars)
    return explode_once(df, long, "content", *keep)


def _seen(raw: DataFrame) -> list[Column]:
    """Order in which records were seen: by file, and by place where a file holds several."""
    return [F.col(c) for c in ("path", "record_id") if c in raw.columns]


def clean_articles(raw: DataFrame) -> DataFrame:
    """Encyclopaedia articles: first copy per id, cleaned, typed, short ones dropped."""
    df = keep_first(raw.filter(F.coalesce("id", F.lit("")) != ""), ["id"], _seen(raw))
    df = cleaned_texts(df, "content", *[c for c in df.columns if c != "content"])
    none = F.array().cast("array<string>")
    return df.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        classify_by_category("category").alias("type"), F.coalesce("category", F.lit("")).alias("category"),
        keep_meaningful_categories(F.coalesce("categories", none)).alias("categories"),
        lead_lines("content").alias("summary"), "content", word_count("content").alias("word_count"),
        F.length("content").cast("long").alias("char_count"), F.coalesce("language", F.lit("vi")).alias("language"),
        F.coalesce("crawled_at", F.lit("")).alias("crawled_at"), F.coalesce("last_modified", F.lit("")).alias("last_modified"))


def long_enough(min_chars: int = V.MIN_BOOK_CHARS) -> Column:
    """First non-empty of content and summary has at least ``min_chars`` characters."""
    return F.length(F.coalesce(F.nullif("content", F.lit("")), F.col("summary"), F.lit(""))) >= min_chars


def topic_text() -> Column:
    none = F.array().cast("array<string>")
    empty = F.lit("")
    return F.concat_ws(" ", F.coalesce("title", empty), F.array_join(F.coalesce("categories", none), " "),
                       F.coalesce("genre", empty), F.coalesce("crawl_category", empty))


def clean_books(raw: DataFrame, languages=tuple(V.KEEP_LANGS), filter_topic: bool = True) -> DataFrame:
    """Book records: language, length, topic, one copy per title and author, cleaned."""
    df = raw.filter(F.coalesce("language", F.lit("")).isin(*languages)).filter(long_enough())
    if filter_topic:
        df = df.filter(on_topic(topic_text()))
    df = keep_longest(df, title_author_key(), "content", *_seen(df))
    content = clean_book_text("content")
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.substring(F.col("_content"), 1, 500))
    df = df.withColumn("_content", content)
    return df.select(
        "id", strip(F.coalesce("title", F.lit(""))).alias("title"), "url", F.lit("google_books").alias("source"),
        strip(F.coalesce("author", F.lit(""))).alias("author"), "authors", "publication_year", "genre", "genres",
        "publisher", "page_count", "isbn", "isbn_list", "cover_url", clean_book_text(summary).alias("summary"),
        F.col("_content").alias("content"), "categories", "crawl_category", F.coalesce("language", F.lit("vi")).alias("language"),
        word_count("_content").alias("word_count"), F.length("_content").cast("long").alias("char_count"))


def funnel(raw: DataFrame, *, languages=tuple(V.KEEP_LANGS), filter_topic: bool = True,
           language: str = "language", text: Column | None = None, topic: Column | None = None,
           keys: list[Column] | None = None) -> DataFrame:
    """One row: rows left after each stage.

    The stages are nested conditions of one scan; deduplication is a count of keys among
    the rows that pass, so no stage is computed twice.
    """
    named = [c.alias(f"k{i}") for i, c in enumerate(keys or title_author_key())]
    size_ok = (F.length(text) >= V.MIN_BOOK_CHARS) if text is not None else long_enough()
    topic_ok = on_topic(topic if topic is not None else topic_text()) if filter_topic else F.lit(True)
    l = raw.withColumn("_l", F.coalesce(F.col(language), F.lit("")).isin(*languages)).withColumn("_s", F.col("_l") & size_ok)
    flags = l.withColumn("_t", F.when(F.col("_s"), topic_ok).otherwise(F.lit(False))).select(
        F.col("_l").alias("l"), F.col("_s").alias("s"), F.col("_t").alias("t"),
        F.when(F.col("_t"), F.sha2(F.to_json(F.struct(*named)), 256)).alias("key"))
    per_key = flags.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l").cast("long")).alias("l"),
                                       F.sum(F.col("s").cast("long")).alias("s"), F.sum(F.col("t").cast("long")).alias("t"))
    return per_key.agg(F.sum("n").alias("total_raw"), F.sum("l").alias("after_lang"), F.sum("s").alias("after_short"),
                       F.sum("t").alias("after_topic"), F.count("key").alias("after_dedup"))


def clean_archive(texts: DataFrame) -> DataFrame:
    """Whole text files -> archive records; files below the minimum length drop."""
    return texts.filter(F.length("content") >= V.MIN_CLEAN_CHARS).select(
        archive_id("title", "author").alias("id"), "title", "author", F.lit("work").alias("type"),
        F.lit("archive").alias("source"), prefix("content", 500).alias("summary"), "content",
        F.lit("vi").alias("language"), word_count("content").alias("word_count"),
        F.length("content").cast("long").alias("char_count"))


def book_cards(archive: DataFrame) -> DataFrame:
    """Archive records -> compact cards, the text that is embedded."""
    df = archive.filter(nonblank("title").isNotNull())
    author = F.coalesce("author", F.lit(V.UNKNOWN_AUTHOR))
    card = book_card(F.col("title"), author, F.coalesce("word_count", F.lit(0)), F.col("content"))
    return df.select("id", strip("title").alias("title"), author.alias("author"), F.lit("work").alias("type"),
                     F.lit("archive_compact").alias("source"), card.alias("content"), "word_count",
                     F.length(card).cast("long").alias("char_count"), F.lit("vi").alias("language"))
