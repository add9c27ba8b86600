"""Counts, distributions and the category walk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfspark.functions.text import vn_number, word_count
from shelfspark.operators import keyed, quality, taxonomy
from shelfspark.plans.registry import sql as S
from shelfspark.session import shared_dir
from shelfspark.sources.sinks import run_stats, sheet_rows, type_sheets, write_observed
from shelfspark.sources.tables import load


def language_shares(spark, d):
    return keyed.share_by(load(spark, d, "documents", "source", "lang"), "source", "lang", decimals=2)


SQL_SHARES = "SELECT source, lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY 1, 2"


def top_sources(spark, d):
    return keyed.most_common(load(spark, d, "documents", "source"), "source", 15)


SQL_TOP = "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 15"


def length_histogram(spark, d):
    return quality.length_histogram(load(spark, d, "documents", "text"), word_count("text"))


SQL_HIST = f"""
SELECT CASE WHEN w < 50 THEN '<50' WHEN w < 200 THEN '50-200' WHEN w < 500 THEN '200-500' ELSE '>500' END AS bucket, count(*) AS n
FROM (SELECT {S.word_count('text')} AS w FROM documents) GROUP BY 1"""


def corpus_overview(spark, d):
    return quality.overview(load(spark, d, "documents", "lang", "text"), word_count("text"), "lang")


_FIG = "count(*) AS n_docs, CAST(floor(avg(w)) AS BIGINT) AS avg_words, max(w) AS max_words, min(w) AS min_words, CAST(sum(w) AS BIGINT) AS total_words"
SQL_OVERVIEW = f"""
WITH w AS (SELECT lang, {S.word_count('text')} AS w FROM documents)
SELECT lang, {_FIG} FROM w GROUP BY 1 UNION ALL SELECT 'ALL', {_FIG} FROM w"""


def formatted_totals(spark, d):
    o = corpus_overview(spark, d)
    return o.select("lang", vn_number("total_words").alias("total_words"))


SQL_FORMATTED = f"WITH o AS ({SQL_OVERVIEW}) SELECT lang, replace(format('{{:,}}', total_words), ',', '.') AS total_words FROM o"


def description_quality(spark, d):
    return quality.description_quality(load(spark, d, "documents", "text"), F.col("text"))


SQL_QUALITY = """
SELECT count(*) AS total, count(*) FILTER (length(text) >= 50) AS has_desc, count(*) FILTER (length(text) < 50) AS no_desc,
 round(avg(CASE WHEN length(text) >= 50 THEN 1 ELSE 0 END) * 100, 1) AS has_pct, round(coalesce(avg(length(text)) FILTER (length(text) >= 50), 0), 2) AS avg_len FROM documents"""


def short_records(spark, d):
    return quality.short_and_empty(load(spark, d, "documents", "text", "lang"), "text", "lang")


SQL_SHORT = "SELECT lang, count(*) AS n, count(*) FILTER (strlen(text) < 500) AS too_short, count(*) FILTER (text = '') AS empty_content FROM documents GROUP BY 1"


def progress_totals(spark, d):
    return quality.progress_total(load(spark, d, "events", "event_type", "props"), "props", "event_type")


SQL_PROGRESS = "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1"


def run_figures(spark, d):
    docs = load(spark, d, "documents", "text", "lang", "n_chars")
    return run_stats(docs, total=F.lit(True), processed=F.col("n_chars") >= 50, skipped=F.col("n_chars") < 50, in_english=F.col("lang") == "en")


SQL_RUN = "SELECT count(*) AS total, count(*) FILTER (n_chars >= 50) AS processed, count(*) FILTER (n_chars < 50) AS skipped, count(*) FILTER (lang = 'en') AS in_english FROM documents"


def sheet_content(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars")
    e = F.lit("")
    return sheet_rows(docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("work").alias("type"), F.col("lang").alias("category"), word_count("text").alias("word_count"),
        F.col("n_chars").alias("char_count"), F.col("text").alias("summary"), F.array("lang", "source").alias("categories"), e.alias("crawled_at"), e.alias("last_modified"), e.alias("url")))


SQL_SHEET = f"""
SELECT doc_id AS id, source AS title, 'work' AS type, lang AS category, {S.word_count('text')} AS word_count, n_chars AS char_count, substr(text, 1, 200) AS summary_preview,
 lang || ' | ' || source AS categories_str, '' AS crawled_at, '' AS last_modified, '' AS url FROM documents"""


def _edges(spark, d):
    n = load(spark, d, "nation", "n_nationkey", "n_regionkey")
    c = load(spark, d, "customer", "c_custkey", "c_nationkey")
    o = load(spark, d, "orders", "o_orderkey", "o_custkey")
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    return edge(n, node("R", "n_regionkey"), node("N", "n_nationkey")).unionAll(
        edge(c, node("N", "c_nationkey"), node("C", "c_custkey"))).unionAll(edge(o, node("C", "o_custkey"), node("O", "o_orderkey")))


def category_walk(spark, d):
    roots = load(spark, d, "region", "r_regionkey").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root"))
    seen = taxonomy.walk(_edges(spark, d), roots, 3)
    return seen.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


_EDGES = """e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
 UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders),
 w AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS category, 0 AS depth FROM region UNION SELECT root, child, depth + 1 FROM w JOIN e ON e.parent = w.category WHERE depth < 3)"""
SQL_WALK = f"WITH RECURSIVE {_EDGES} SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM w GROUP BY 1, 2"


def category_pages(spark, d):
    roots = load(spark, d, "region", "r_regionkey").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root"))
    members = load(spark, d, "lineitem", "l_orderkey", "l_partkey").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("category"), F.col("l_partkey").alias("page_id"))
    pages = taxonomy.pages_under(taxonomy.walk(_edges(spark, d), roots, 3), members)
    return pages.groupBy("root").agg(F.count(F.lit(1)).alias("n_pages"), F.min("depth").alias("depth"))


SQL_PAGES = f"""WITH RECURSIVE {_EDGES} SELECT root, count(DISTINCT l_partkey) AS n_pages, CAST(min(depth) AS BIGINT) AS depth FROM w JOIN lineitem ON 'O' || l_orderkey = category GROUP BY 1"""

def observed_run(spark, d):
    """The same figures, gathered while the records are written."""
    docs = load(spark, d, "documents", "doc_id", "lang", "n_chars")
    path = f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/observed-{uuid.uuid4().hex}"
    seen = write_observed(docs, path, total=F.lit(True), processed=F.col("n_chars") >= 50, skipped=F.col("n_chars") < 50, in_english=F.col("lang") == "en")
    return spark.range(1).select(*[F.lit(seen[c]).cast("long").alias(c) for c in ("total", "processed", "skipped", "in_english")])


def type_overview(spark, d):
    docs = load(spark, d, "documents", "lang", "source", "n_chars")
    return type_sheets(docs.select(F.col("lang").alias("type"), F.col("source").alias("category"), F.col("n_chars").alias("word_count")))


SQL_TYPES = """
WITH g AS (SELECT lang AS type, source AS category, grouping(lang) AS gt, grouping(source) AS gc, count(*) AS articles, CAST(sum(n_chars) AS BIGINT) AS words, max(n_chars) AS most_words, min(n_chars) AS least_words
  FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())),
 r AS (SELECT *, CASE WHEN gc = 0 THEN row_number() OVER (PARTITION BY gt, gc, CASE WHEN gc = 0 THEN type END ORDER BY articles DESC, category) - 1 END AS rank FROM g)
SELECT type, category, rank, articles, words, most_words, least_words FROM r WHERE rank IS NULL OR rank < 15"""

ENTRIES = {
    "observed_run": (observed_run, SQL_RUN),
    "type_sheets": (type_overview, SQL_TYPES),
    "language_shares": (language_shares, SQL_SHARES),
    "top_sources": (top_sources, SQL_TOP),
    "length_histogram": (length_histogram, SQL_HIST),
    "corpus_overview": (corpus_overview, SQL_OVERVIEW),
    "formatted_totals": (formatted_totals, SQL_FORMATTED),
    "description_quality": (description_quality, SQL_QUALITY),
    "short_records": (short_records, SQL_SHORT),
    "progress_totals": (progress_totals, SQL_PROGRESS),
    "run_figures": (run_figures, SQL_RUN),
    "sheet_content": (sheet_content, SQL_SHEET),
    "category_walk": (category_walk, SQL_WALK),
    "category_pages": (category_pages, SQL_PAGES),
}
