"""Responses of remote catalogues, written from the tables as a recorder would, and read as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.text import strip
from shelfspark.plans.registry import sql as S
from shelfspark.session import shared_dir
from shelfspark.sources import readers, remote, sinks
from shelfspark.sources.tables import load


def _text(html):
    """A page as plain paragraphs: a line break between two tags."""
    return F.replace(html, F.lit("><"), F.lit(">\n \n<"))


def page_rows(spark, d):
    """Page responses: some missing or invalid, some broken, some without address, item, categories or revision."""
    p = load(spark, d, "pages", "page_id", "url", "html")
    n, none = F.col("page_id") % 10, F.lit(None).cast("string")
    some = lambda cond, c: F.when(cond, c)
    page = F.struct(
        F.col("page_id").alias("pageid"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.when(n == 3, F.lit("short")).otherwise(_text(F.col("html"))).alias("extract"),
        some(n != 4, F.col("url")).alias("fullurl"), F.lit("2024-01-01T00:00:00Z").alias("touched"), F.when(n == 1, F.lit("")).otherwise(none).alias("missing"), F.when(n == 2, F.lit("")).otherwise(none).alias("invalid"),
        some(n != 5, F.array(F.struct(F.concat(F.lit("Thể loại:"), F.substring_index("url", "/", 3)).alias("title")), F.struct(F.lit("Thể_loại:Khác").alias("title")))).alias("categories"),
        some(n != 6, F.array(F.struct(F.struct(F.struct(F.col("url").alias("*")).alias("main")).alias("slots")))).alias("revisions"),
        some(n != 7, F.struct(F.concat(F.lit("Q"), F.col("page_id").cast("string")).alias("wikibase_item"))).alias("pageprops"))
    body = F.to_json(F.struct(F.struct(F.create_map(F.col("page_id").cast("string"), page).alias("pages")).alias("query")))
    rows = remote.parse_pages(p.select(F.lit("c").alias("crawl_category"), F.when(n == 8, F.substring(body, 1, 40)).otherwise(body).alias("body")))
    return rows.select("id", "title", "url", F.md5("summary").alias("summary_md5"), F.md5("content").alias("content_md5"), "wikitext", "wikidata_id", F.array_join("categories", "|").alias("categories"),
                       F.col("word_count").cast("long").alias("word_count"), F.col("char_count").cast("long").alias("char_count"), "crawl_category", "last_modified")


SQL_PAGE_ROWS = f"""WITH p AS (SELECT page_id, page_id % 10 AS n, url, replace(html, '><', '>' || chr(10) || ' ' || chr(10) || '<') AS t FROM pages)
SELECT CAST(page_id AS VARCHAR) AS id, 'Page ' || page_id AS title, CASE WHEN n = 4 THEN 'https://vi.wikipedia.org/?curid=' || page_id ELSE url END AS url,
 md5(array_to_string(list_slice(list_filter([{S.strip('x')} FOR x IN string_split(t, chr(10))], LAMBDA x: x <> ''), 1, 3), chr(10))) AS summary_md5, md5(t) AS content_md5,
 CASE WHEN n = 6 THEN '' ELSE url END AS wikitext, CASE WHEN n = 7 THEN '' ELSE 'Q' || page_id END AS wikidata_id,
 CASE WHEN n = 5 THEN '' ELSE array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') || '|Khác' END AS categories, {S.word_count('t')} AS word_count, length(t) AS char_count, 'c' AS crawl_category, '2024-01-01T00:00:00Z' AS last_modified
FROM p WHERE n NOT IN (1, 2, 3, 8) AND length(t) >= 150"""


def listed_members(spark, d):
    """Category listings of two members each."""
    docs = load(spark, d, "documents", "doc_id", "lang", "source")
    member = lambda i, ns, title: F.struct(i.alias("pageid"), F.lit(ns).alias("ns"), title.alias("title"))
    both = F.array(member(F.col("doc_id"), 0, F.col("source")), member(F.col("doc_id") + 1, 14, F.concat(F.when(F.col("doc_id") % 2 == 0, "Thể loại:").otherwise("Thể_loại:"), "lang")))
    body = F.to_json(F.struct(F.struct(both.alias("categorymembers")).alias("query")))
    return remote.parse_members(docs.select(F.concat("lang", F.lit("/"), "source").alias("key"), body.alias("body")))


SQL_MEMBERS = """SELECT lang || '/' || source AS category, doc_id AS page_id, source AS title, FALSE AS is_category FROM documents
UNION ALL SELECT lang || '/' || source, doc_id + 1, lang, TRUE FROM documents"""


def searched_volumes(spark, d):
    """Result pages of the book search; volumes without title or with a short description drop."""
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars")
    n = F.col("doc_id") % 7
    number = lambda kind, prefix: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("identifier"))
    info = F.struct(
        F.when(n == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source")).alias("title"), F.when(n != 2, F.array("lang", "source")).alias("authors"), F.col("text").alias("description"),
        F.concat((F.col("n_chars") % 300 + 1800).cast("string"), F.lit("-03-01")).alias("publishedDate"),
        F.when(n == 3, F.array(number("OTHER", "x"))).when(n == 4, F.array(number("ISBN_10", "0"))).otherwise(F.array(number("ISBN_10", "0"), number("ISBN_13", "9780"))).alias("industryIdentifiers"),
        F.when(n == 5, F.lit("http://b")).alias("infoLink"), F.when(n == 6, F.struct(F.lit("s.png").alias("smallThumbnail"))).alias("imageLinks"))
    body = F.to_json(F.struct(F.lit(1).alias("totalItems"), F.array(F.struct(F.col("doc_id").cast("string").alias("id"), info.alias("volumeInfo"))).alias("items")))
    v = remote.parse_volumes(docs.select(F.col("lang").alias("key"), body.alias("body")))
    return v.select("id", "title", "url", F.md5("content").alias("content_md5"), "author", F.array_join("authors", "|").alias("authors"), "publication_year", "isbn", "cover_url", "author_source", "year_source",
                    "crawl_category", F.col("word_count").cast("long").alias("word_count"), F.col("char_count").cast("long").alias("char_count"))


SQL_VOLUMES = f"""WITH v AS (SELECT *, doc_id % 7 AS n, {S.strip('text')} AS c, n_chars % 300 + 1800 AS y, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS num FROM documents)
SELECT 'gbooks_' || doc_id AS id, source AS title, CASE WHEN n = 5 THEN 'http://b' ELSE 'https://books.google.com/books?id=' || doc_id END AS url, md5(c) AS content_md5,
 CASE WHEN n = 2 THEN '' ELSE lang END AS author, CASE WHEN n = 2 THEN '' ELSE lang || '|' || source END AS authors, CASE WHEN y >= 1900 THEN CAST(y AS VARCHAR) ELSE '' END AS publication_year,
 CASE WHEN n = 3 THEN '' WHEN n = 4 THEN '0' || num ELSE '9780' || num END AS isbn, CASE WHEN n = 6 THEN 's.png' ELSE '' END AS cover_url, CASE WHEN n = 2 THEN '' ELSE 'google_books' END AS author_source,
 CASE WHEN y >= 1900 THEN 'google_books' ELSE '' END AS year_source, lang AS crawl_category, {S.word_count('c')} AS word_count, length(c) AS char_count
FROM v WHERE n <> 1 AND length(c) >= 20"""


def claim_fields(spark, d):
    """Entity responses and the labels that they refer to."""
    p = load(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    claim = lambda value: F.struct(F.struct(F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak"))
    ref = lambda kind, c: claim(F.struct(F.concat(F.lit(kind), c.cast("string")).alias("id")))
    time = lambda year: F.array(claim(F.struct(F.concat(F.lit("+"), year.cast("string"), F.lit("-01-01T00:00:00Z")).alias("time"))))
    claims = F.struct(F.when(F.col("p_size") % 3 != 0, time(F.col("p_size") + 1900)).alias("P577"), F.array(ref("A", F.col("p_partkey")), ref("N", F.col("p_partkey")), ref("B", F.col("p_brand"))).alias("P50"),
                      F.array(ref("G", F.col("p_size"))).alias("P136"), time(F.col("p_size") + 1800).alias("P569"))
    entities = p.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), F.to_json(F.struct(claims.alias("claims"))).alias("body"))
    label = lambda kind, c, name: p.select(F.concat(F.lit(kind), c.cast("string")).alias("qid"), name.alias("label"))
    labels = (label("A", F.col("p_partkey"), F.col("p_name")).unionByName(label("N", F.col("p_partkey"), F.lit("")))
              .unionByName(label("B", F.col("p_brand"), F.col("p_brand"))).unionByName(label("G", F.col("p_size"), F.concat(F.lit("g"), F.col("p_size").cast("string"))).filter("qid <> 'G7'"))).distinct()
    c = remote.parse_claims(entities, labels)
    return c.select("qid", "publication_year", "birth_year", "death_year", F.array_join("authors", "|").alias("authors"), "author", "genre", "nationality")


SQL_CLAIMS = """SELECT 'Q' || p_partkey AS qid, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size + 1900 AS VARCHAR) ELSE '' END AS publication_year, CAST(p_size + 1800 AS VARCHAR) AS birth_year, '' AS death_year,
 p_name || '|' || p_brand AS authors, p_name AS author, CASE WHEN p_size = 7 THEN '' ELSE 'g' || p_size END AS genre, '' AS nationality FROM part"""

def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def raw_records(spark, d):
    """Raw JSON folders: files of several records one after the other, some of them broken."""
    docs, path = load(spark, d, "documents", "doc_id", "text", "lang", "source"), _place(spark, "raw")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.array("lang").alias("categories"), F.lit(1).alias("unknown_field")))
    docs.select("lang", F.when(F.col("doc_id") % 9 == 1, F.lit("{broken}")).otherwise(record).alias("value")).write.partitionBy("lang").text(path)
    r = readers.read_json_folder(spark, path, readers.RECORD_SCHEMA, "*.txt")
    return r.select("id", "title", F.md5("content").alias("content_md5"), F.array_join("categories", "|").alias("categories"), "folder")


SQL_RAW = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, md5(text) AS content_md5, lang AS categories, 'lang=' || lang AS folder FROM documents WHERE doc_id % 9 <> 1"


def metadata_csv(spark, d):
    """A metadata table written with its mark and read again: quotes, line breaks and blanks inside."""
    docs, path = load(spark, d, "documents", "doc_id", "text", "source"), _place(spark, "csv")
    named = docs.select(*[{"id": F.col("doc_id").cast("string"), "title": F.concat(F.lit('"'), "source", F.lit('", ,\n"')), "summary": strip("text")}.get(c, F.lit(None).cast("string")).alias(c) for c in V.CATALOG_COLUMNS])
    sinks.write_csv(named, path)
    return readers.read_metadata_csv(spark, path).select("id", "title", F.md5(F.coalesce("summary", F.lit(""))).alias("summary_md5"), "ai_filled")


SQL_CSV = f"""SELECT CAST(doc_id AS VARCHAR) AS id, '"' || source || '", ,' || chr(10) || '"' AS title, md5({S.strip('text')}) AS summary_md5, CAST(NULL AS VARCHAR) AS ai_filled FROM documents"""


ENTRIES = {
    "raw_records": (raw_records, SQL_RAW),
    "metadata_csv": (metadata_csv, SQL_CSV),
    "page_rows": (page_rows, SQL_PAGE_ROWS),
    "listed_members": (listed_members, SQL_MEMBERS),
    "searched_volumes": (searched_volumes, SQL_VOLUMES),
    "claim_fields": (claim_fields, SQL_CLAIMS),
}
