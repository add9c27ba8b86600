"""Paged remote catalogues as a Spark data source.

Each request key (category, search phrase, page address) is one input partition; a
partition follows its own continuation until the last page. Responses come from a folder
of recorded pages by default, so plans and tests run offline; a live transport is passed
in by name and is never chosen implicitly.
"""

from __future__ import annotations

import importlib
import itertools
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfspark import fixed_values as V
from shelfspark.functions.extract import (
    claim_year, content_author, content_genre, content_year, map_book_genre, parse_infobox, pick_isbn,
    split_names, with_provenance, year_modern)
from shelfspark.functions.text import lead_lines, strip, word_count

Transport = Callable[[str, int], str | None]


@dataclass
class RequestKey(InputPartition):
    key: str


class PagedCatalogue(DataSource):
    """Options: ``keys`` (JSON list), ``transport`` ('module:function'), ``retries``, ``delay``
    seconds, and ``max_pages``; without it a catalogue is followed to its last page."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self) -> str:
        return "key string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[RequestKey]:
        return [RequestKey(k) for k in json.loads(self.options["keys"])]

    def _transport(self) -> Transport:
        module, name = self.options["transport"].split(":")
        return getattr(importlib.import_module(module), name)

    def read(self, partition: RequestKey) -> Iterator[tuple]:
        fetch = self._transport()
        retries, delay = int(self.options.get("retries", 3)), float(self.options.get("delay", 0))
        last = self.options.get("max_pages")
        for page in range(int(last)) if last else itertools.count():
            for attempt in range(retries):
                try:
                    body = fetch(partition.key, page)
                    break
                except (ConnectionError, TimeoutError):
                    if attempt == retries - 1:
                        raise
                    time.sleep(delay * 2 ** attempt)
            if body is None:
                return
            yield partition.key, page, body
            time.sleep(delay)


def _safe(key: str) -> str:
    return re.sub(r"[^\w.-]+", "_", key)


def read_recorded(spark: SparkSession, keys: list[str], folder: str, max_pages: int | None = None) -> DataFrame:
    """(key, page, body) of the recorded responses ``<folder>/<safe key>/<page>.json``, read by Spark
    from any file system; a key ends at the first page that was not recorded."""
    names = spark.createDataFrame([(k, _safe(k)) for k in dict.fromkeys(keys)], "key string, place string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    pages = files.select(F.regexp_extract(path, r"([^/]+)/[^/]+\z", 1).alias("place"), F.regexp_extract(path, r"(\d+)\.json\z", 1).cast("int").alias("page"),
                         F.col("value").alias("body"))
    found = pages.join(F.broadcast(names), "place")
    place = F.row_number().over(Window.partitionBy("key").orderBy("page")) - 1
    out = found.withColumn("place", place).filter(F.col("place") == F.col("page")).select("key", "page", "body")
    return out.filter(F.col("page") < max_pages) if max_pages else out


def read_catalogue(spark: SparkSession, keys: list[str], folder: str | None = None, **options: str) -> DataFrame:
    """Responses of every key, all pages; recorded ones unless a transport is named."""
    if folder is not None:
        return read_recorded(spark, keys, folder, int(options["max_pages"]) if "max_pages" in options else None)
    spark.dataSource.register(PagedCatalogue)
    return spark.read.format("paged_catalogue").option("keys", json.dumps(keys, ensure_ascii=False)).options(**options).load()


def read_volume_search(spark: SparkSession, phrases: list[str], **options: str) -> DataFrame:
    """Result pages of the book search, which are cut at VOLUME_SEARCH_PAGES."""
    return read_catalogue(spark, phrases, **{"max_pages": str(V.VOLUME_SEARCH_PAGES), **options})


# ------------------------------------------------------------------ responses -> rows
_VOLUMES = ("struct<totalItems:bigint,items:array<struct<id:string,volumeInfo:struct<title:string,authors:array<string>,"
            "description:string,publishedDate:string,categories:array<string>,industryIdentifiers:array<struct<type:string,"
            "identifier:string>>,imageLinks:struct<thumbnail:string,smallThumbnail:string>,infoLink:string,publisher:string,"
            "pageCount:int,language:string>>>>")


def parse_volumes(pages: DataFrame, min_description: int = 20) -> DataFrame:
    """Search-result pages -> book rows; volumes without title or usable description drop."""
    v = pages.select("key", F.explode(F.from_json("body", _VOLUMES)["items"]).alias("i")).select(
        "key", "i.id", "i.volumeInfo.*").filter(F.coalesce("id", F.lit("")) != "")
    none = F.array().cast("array<string>")
    authors, cats = F.coalesce("authors", none), F.coalesce("categories", none)
    ids = F.transform(F.filter(F.coalesce("industryIdentifiers", F.array().cast("array<struct<type:string,identifier:string>>")),
                               lambda x: x["type"].isin("ISBN_13", "ISBN_10")), lambda x: F.coalesce(x["identifier"], F.lit("")))
    content = strip(F.coalesce("description", F.lit("")))
    year = year_modern(F.coalesce("publishedDate", F.lit("")))
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    mark = lambda c: F.when(c != "", F.lit("google_books")).otherwise(F.lit(""))
    genre = map_book_genre(first(cats))
    return v.select(
        F.concat(F.lit("gbooks_"), "id").alias("id"), strip(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce(F.nullif("infoLink", F.lit("")), F.concat(F.lit("https://books.google.com/books?id="), "id")).alias("url"),
        F.substring(content, 1, 500).alias("summary"), content.alias("content"), first(authors).alias("author"),
        F.slice(authors, 1, 5).alias("authors"), year.alias("publication_year"), genre.alias("genre"),
        F.transform(cats, map_book_genre).alias("genres"), pick_isbn(ids).alias("isbn"), ids.alias("isbn_list"),
        F.coalesce("publisher", F.lit("")).alias("publisher"), F.coalesce("pageCount", F.lit(0)).alias("page_count"),
        F.coalesce(F.nullif("imageLinks.thumbnail", F.lit("")), "imageLinks.smallThumbnail", F.lit("")).alias("cover_url"),
        F.lit("google_books").alias("source"), mark(first(authors)).alias("author_source"), mark(year).alias("year_source"),
        mark(genre).alias("genre_source"), F.col("key").alias("crawl_category"), cats.alias("categories"),
        F.coalesce("language", F.lit("vi")).alias("language"), word_count(content).cast("int").alias("word_count"),
        F.length(content).alias("char_count"),
    ).filter((F.col("title") != "") & (F.length("content") >= min_description))


_MEMBERS = "struct<query:struct<categorymembers:array<struct<pageid:bigint,ns:int,title:string>>>>"


def parse_members(pages: DataFrame) -> DataFrame:
    """Category listings -> (category, page_id, title, is_category)."""
    m = pages.select(F.col("key").alias("category"), F.explode(F.from_json("body", _MEMBERS)["query"]["categorymembers"]).alias("m"))
    return m.select("category", F.col("m.pageid").alias("page_id"),
                    F.regexp_replace("m.title", r"\AThể[ _]loại:", "").alias("title"), (F.col("m.ns") == 14).alias("is_category"))


_CLAIMS = "struct<claims:struct<" + ",".join(f"{p}:array<struct<mainsnak:struct<datavalue:struct<value:string>>>>" for p in V.CLAIM_PROPERTIES.values()) + ">>"


def _claim(claims: Column, prop: str, n: int) -> Column:
    """Raw JSON values of the first ``n`` claims of a property."""
    first = F.slice(claims[V.CLAIM_PROPERTIES[prop]], 1, n)
    return F.array_compact(F.coalesce(F.transform(first, lambda c: c["mainsnak"]["datavalue"]["value"]), F.array().cast("array<string>")))


def parse_claims(entities: DataFrame, labels: DataFrame, body: str = "body") -> DataFrame:
    """Entity JSON -> qid, years and labelled author / genre / nationality.

    A body is decoded once. Labels come from ``labels(qid, label)`` by a join per referenced entity,
    the names of an entity by one aggregate.
    """
    c = F.from_json(F.col(body), _CLAIMS)["claims"]
    year = lambda p: claim_year(F.coalesce(F.get_json_object(F.get(_claim(F.col("_c"), p, 1), F.lit(0)), "$.time"), F.lit("")))
    refs = lambda p, n: F.transform(_claim(F.col("_c"), p, n), lambda v, i: F.struct(F.lit(p).alias("field"), i.alias("pos"), F.get_json_object(v, "$.id").alias("ref")))
    read = entities.select("qid", c.alias("_c"))
    e = read.select("qid", year("publication_date").alias("publication_year"), year("birth").alias("birth_year"), year("death").alias("death_year"))
    flat = read.select("qid", F.explode(F.concat(refs("author", 5), refs("genre", 3), refs("nationality", 1))).alias("r")).select("qid", "r.*")
    wide = (flat.join(labels.select(F.col("qid").alias("ref"), "label"), "ref").filter(F.coalesce("label", F.lit("")) != "")
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("field", "pos", "label"))).alias("_all")))
    pick = lambda f: F.transform(F.filter("_all", lambda s: s["field"] == f), lambda s: s["label"])
    wide = wide.select("qid", pick("author").alias("authors"), pick("genre").alias("genres"), pick("nationality").alias("_nat"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return e.join(wide, "qid", "left").select(
        "qid", "publication_year", "birth_year", "death_year", "authors", "genres",
        first("authors").alias("author"), first("genres").alias("genre"), first("_nat").alias("nationality"))


def build_books(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """Fetched articles ``(id, content, wikitext, wikidata_id, categories, ...)`` -> book rows.

    Each field comes from the infobox, else the claims, else the text, and names its origin.
    """
    c = claims.select(F.col("qid").alias("wikidata_id"), *[F.col(x).alias(f"_c_{x}") for x in ("author", "authors", "publication_year", "genre", "genres")])
    a = articles.withColumn("_box", parse_infobox("wikitext")).join(c, "wikidata_id", "left")
    box = lambda k: F.try_element_at("_box", F.lit(k))
    a = (a.withColumn("_g", content_genre("content", "categories"))
         .withColumn("_author", with_provenance(("infobox", box("author")), ("wikidata", F.col("_c_author")), ("regex", content_author("content"))))
         .withColumn("_year", with_provenance(("infobox", box("publication_year")), ("wikidata", F.col("_c_publication_year")), ("regex", content_year("content"))))
         .withColumn("_genre", with_provenance(("infobox", box("genre")), ("wikidata", F.col("_c_genre")), ("text", F.col("_g.genre")))))
    many = lambda f, plural: F.when((F.col(f"_{f}.source") == "wikidata"), F.col(f"_c_{plural}")).when(
        F.col(f"_{f}.value") != "", F.array(F.col(f"_{f}.value"))).otherwise(F.array().cast("array<string>"))
    out = a.withColumns({
        "author": F.col("_author.value"), "author_source": F.col("_author.source"), "authors": many("author", "authors"),
        "publication_year": F.col("_year.value"), "year_source": F.col("_year.source"),
        "genre": F.col("_genre.value"), "genres": many("genre", "genres"),
        "genre_source": F.when(F.col("_genre.source") == "text", F.col("_g.genre_source")).otherwise(F.col("_genre.source"))})
    return out.drop("_box", "_g", "_author", "_year", "_genre", *[x for x in out.columns if x.startswith("_c_")])


def build_authors(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """Fetched articles about people -> author rows."""
    c = claims.select(F.col("qid").alias("wikidata_id"), *[F.col(x).alias(f"_c_{x}") for x in ("birth_year", "death_year", "nationality")])
    a = articles.withColumn("_box", parse_infobox("wikitext")).join(c, "wikidata_id", "left")
    pick = lambda k: with_provenance(("infobox", F.try_element_at("_box", F.lit(k))), ("wikidata", F.col(f"_c_{k}")))
    return a.withColumns({
        "birth_year": pick("birth_year")["value"], "birth_source": pick("birth_year")["source"],
        "death_year": pick("death_year")["value"], "nationality": pick("nationality")["value"],
        "nationality_source": pick("nationality")["source"],
        "notable_works": split_names(F.try_element_at("_box", F.lit("notable_works")))}).drop("_box", "_c_birth_year", "_c_death_year", "_c_nationality")


def long_enough(articles: DataFrame, min_chars: int = V.MIN_ARTICLE_CHARS) -> DataFrame:
    """Articles of enough text, with their first three paragraphs as summary."""
    return articles.filter(F.length(F.coalesce("content", F.lit(""))) >= min_chars).withColumn("summary", lead_lines("content", 3))


def parse_pages(responses: DataFrame, body: str = "body", min_chars: int = V.MIN_ARTICLE_CHARS) -> DataFrame:
    """Page responses -> article rows: id, title, url, summary, content, wikitext, wikidata_id, categories, word_count, char_count, last_modified.

    The map of pages is decoded as a variant, whatever its keys. Missing and invalid pages, broken responses and
    articles that are too short drop; further columns stay.
    """
    pages = F.try_variant_get(F.try_parse_json(F.col(body)), "$.query.pages", "map<string,variant>")
    p = responses.select(*[c for c in responses.columns if c != body], F.explode(pages).alias("_id", "_p"))
    text = lambda path: F.coalesce(F.try_variant_get("_p", path, "string"), F.lit(""))
    there = lambda path: F.try_variant_get("_p", path, "variant").isNotNull()
    listed = F.coalesce(F.try_variant_get("_p", "$.categories", "array<variant>"), F.array().cast("array<variant>"))
    name = lambda c: F.regexp_replace(F.coalesce(F.try_variant_get(c, "$.title", "string"), F.lit("")), V.CATEGORY_PREFIX, "")
    rows = p.filter(~there("$.missing") & ~there("$.invalid")).select(
        *[c for c in responses.columns if c != body], F.col("_id").alias("id"), text("$.title").alias("title"),
        F.coalesce(F.try_variant_get("_p", "$.fullurl", "string"), F.concat(F.lit(V.PAGE_ADDRESS), "_id")).alias("url"), text("$.extract").alias("content"),
        text("$.revisions[0].slots.main['*']").alias("wikitext"), text("$.pageprops.wikibase_item").alias("wikidata_id"), F.transform(listed, name).alias("categories"), text("$.touched").alias("last_modified"))
    return long_enough(rows, min_chars).withColumns({"word_count": word_count("content").cast("int"), "char_count": F.length("content")})
