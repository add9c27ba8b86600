"""Filtering, deduplicating, merging and enriching records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions import extract as X
from shelfspark.functions import text as T
from shelfspark.operators import canon, enrich, entity, keyed, quality
from shelfspark.plans import ingest
from shelfspark.plans.registry import sql as S
from shelfspark.plans.registry.texts import sql_cut
from shelfspark.session import shared_dir
from shelfspark.sources import readers
from shelfspark.sources.sinks import latex_fill_rows, write_records
from shelfspark.sources.tables import load

TITLE = r"\A[^.\n|]*"


def records(spark, d) -> DataFrame:
    """The document table seen as catalogue records of three sources."""
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars")
    src = F.substring("source", 4, 9).cast("int")
    none = F.lit("")
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
        F.when(src % 3 == 0, "work").when(src % 3 == 1, "gbooks").otherwise("archive_compact").alias("folder"),
        T.strip(F.regexp_extract("text", TITLE, 0)).alias("title"),
        F.when(F.col("n_chars") % 5 == 0, none).when(F.col("n_chars") % 2 == 0, F.concat_ws(" ", "lang", "source"))
        .otherwise(F.concat_ws(" ", "source", "lang")).alias("author"),
        F.col("text").alias("content"), F.col("text").alias("summary"),
        F.when(F.col("n_chars") % 3 == 0, (F.col("doc_id") % 100 + 1900).cast("string")).otherwise(none).alias("publication_year"),
        F.when(F.col("n_chars") % 4 == 0, F.col("lang")).otherwise(none).alias("genre"),
        F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit("P"), "source")).otherwise(none).alias("publisher"),
        F.array("lang").alias("categories"), F.col("n_chars").alias("word_count"),
        F.when(F.col("n_chars") % 6 == 0, (F.col("n_chars") % 500).cast("string")).otherwise(none).alias("page_count"),
        F.lit("").alias("url"), F.lit("x").alias("source"))


RECORDS = f"""r AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path,
  CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'gbooks' ELSE 'archive_compact' END AS folder,
  CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'gbooks' ELSE 'archive_compact' END AS src,
  {S.strip("regexp_extract(text, '\\A[^.\\n|]*', 0)")} AS title,
  CASE WHEN n_chars % 5 = 0 THEN '' WHEN n_chars % 2 = 0 THEN lang || ' ' || source ELSE source || ' ' || lang END AS author,
  text AS content, text AS summary,
  CASE WHEN n_chars % 3 = 0 THEN CAST(doc_id % 100 + 1900 AS VARCHAR) ELSE '' END AS publication_year,
  CASE WHEN n_chars % 4 = 0 THEN lang ELSE '' END AS genre, CASE WHEN n_chars % 7 = 0 THEN 'P' || source ELSE '' END AS publisher,
  lang AS category, n_chars AS word_count, CASE WHEN n_chars % 6 = 0 THEN CAST(n_chars % 500 AS VARCHAR) ELSE '' END AS page_count
 FROM documents)"""


# ------------------------------------------------------------------ filters
def book_funnel(spark, d):
    r = records(spark, d).withColumn("language", F.element_at("categories", 1))
    return ingest.funnel(r, languages=("en", "fr"), text=F.col("content"), topic=F.col("content"))


_TOPIC = f"({S.contains_any('lower(content)', V.LITERATURE_KEYWORDS)} OR NOT {S.contains_any('lower(content)', V.IRRELEVANT_KEYWORDS)})"
SQL_FUNNEL = f"""
WITH {RECORDS}, f AS (SELECT *, category IN ('en', 'fr') AS l, category IN ('en', 'fr') AND length(content) >= 20 AS s FROM r),
 g AS (SELECT *, s AND {_TOPIC} AS t FROM f)
SELECT count(*) AS total_raw, count(*) FILTER (l) AS after_lang, count(*) FILTER (s) AS after_short, count(*) FILTER (t) AS after_topic,
 count(DISTINCT CASE WHEN t THEN lower(title) || chr(1) || lower({S.strip('author')}) END) AS after_dedup FROM g"""


def topic_filter(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang")
    return docs.filter(X.on_topic("text")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


SQL_TOPIC = f"SELECT lang, count(*) AS kept FROM documents WHERE {_TOPIC.replace('content', 'text')} GROUP BY 1"


def category_filter(spark, d):
    docs = load(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    cats = F.array("lang", "source", F.col("n_chars").cast("string"), F.concat(F.lit("Trang "), "lang"), F.concat(F.lit("người Sinh năm "), F.col("n_chars").cast("string")))
    return docs.select("doc_id", F.array_join(X.keep_meaningful_categories(cats), " | ").alias("categories"))


SQL_CATEGORIES = "SELECT doc_id, lang || ' | ' || source || CASE WHEN n_chars BETWEEN 1000 AND 9999 THEN '' ELSE ' | ' || n_chars END AS categories FROM documents"


def category_types(spark, d):
    p = load(spark, d, "part", "p_type")
    return p.groupBy(X.classify_by_category("p_type", ("ECONOMY",), ("SMALL", "STANDARD")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


SQL_TYPES = "SELECT CASE WHEN p_type = 'ECONOMY' THEN 'author' WHEN p_type IN ('SMALL', 'STANDARD') THEN 'work' ELSE 'concept' END AS type, count(*) AS n FROM part GROUP BY 1"


# ------------------------------------------------------------------ duplicates
def first_copies(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "source").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return keyed.keep_first(docs, ["k"], [F.col("doc_id")]).select("doc_id", "source")


SQL_FIRST = "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"


def longest_copies(spark, d):
    r = keyed.keep_longest(records(spark, d), keyed.title_author_key(), "content", "path")
    return r.select("path", F.length("content").cast("long").alias("chars"))


SQL_LONGEST = f"""
WITH {RECORDS} SELECT path, length(content) AS chars FROM r
QUALIFY row_number() OVER (PARTITION BY lower(title), lower(author) ORDER BY length(content) DESC, path) = 1"""


# ------------------------------------------------------------------ entities
def entity_chunks(spark, d):
    c = entity.inject_metadata(entity.merge_entities(records(spark, d)))
    return c.select("chunk_id", F.md5("text").alias("text_md5"), "word_count", "char_count", "title", "author", "year", "genre", "publisher", "source")


SQL_ENTITY = f"""
WITH {RECORDS}, k AS (SELECT *, {S.norm_title('title')} AS nt, {S.norm_title('title')} || ' | ' || array_to_string(list_sort({S.words('lower(author)')}), ' ') AS key FROM r WHERE title <> ''),
 bs AS (SELECT key, nt, src, max(path) AS doc_path, min(path) AS fp, count(*) AS n FROM k GROUP BY 1, 2, 3),
 g AS (SELECT key, any_value(nt) AS nt, min(path) AS fp FROM k GROUP BY 1),
 gn AS (SELECT g.*, k.author FROM g JOIN k ON k.path = g.fp),
 si AS (SELECT nt, min(key) AS target FROM gn WHERE author <> '' GROUP BY nt HAVING count(*) = 1),
 mv AS (SELECT gn.key, si.target FROM gn JOIN si USING (nt) WHERE gn.author = ''),
 pl AS (SELECT coalesce(mv.target, bs.key) AS key, mv.target IS NOT NULL AS moved, src, doc_path, fp, n FROM bs LEFT JOIN mv ON mv.key = bs.key),
 one AS (SELECT *, sum(n) OVER (PARTITION BY key, src) AS np FROM pl QUALIFY row_number() OVER (PARTITION BY key, src ORDER BY moved, fp) = 1),
 doc AS (SELECT one.key, one.src, moved, fp, k.author, k.content, k.publication_year, k.publisher, k.genre, k.category, k.word_count, CASE one.src WHEN 'wikipedia' THEN 1 WHEN 'archive_compact' THEN 2 ELSE 3 END AS p,
   kn.title AS ntitle, kn.author AS nauthor, k.summary FROM one JOIN k ON k.path = one.doc_path JOIN k kn ON kn.path = one.fp),
 w AS (SELECT key, arg_min(ntitle, (moved, fp)) AS title, arg_min(nauthor, (moved, fp)) AS nauthor,
   coalesce(arg_min(author, p) FILTER (author <> ''), '') AS author,
   coalesce(arg_min(publication_year, p) FILTER (publication_year <> ''), '') AS year, coalesce(arg_min(publisher, p) FILTER (publisher <> ''), '') AS publisher,
   coalesce(arg_min(genre, p) FILTER (genre <> ''), '') AS genre, max(category) FILTER (src = 'gbooks') AS gcat, max(word_count) FILTER (src = 'archive_compact') AS aw,
   string_agg(src, ', ' ORDER BY src) AS source,
   {S.strip("coalesce(max(content) FILTER (src = 'wikipedia'), max(CASE WHEN summary <> '' THEN summary ELSE content END) FILTER (src = 'gbooks'), max(content) FILTER (src = 'archive_compact'), '')")} AS summary
   FROM doc GROUP BY key),
 v AS (SELECT *, CASE WHEN author <> '' THEN author ELSE nauthor END AS au, coalesce(gcat, genre) AS gs FROM w WHERE summary <> ''),
 t AS (SELECT *, '[Tiêu đề: ' || title || ']' || CASE WHEN au <> '' THEN ' | [Tác giả: ' || au || ']' ELSE '' END || CASE WHEN year <> '' THEN ' | [Năm xuất bản: ' || year || ']' ELSE '' END
   || CASE WHEN gs <> '' THEN ' | [Thể loại: ' || gs || ']' ELSE '' END || CASE WHEN publisher <> '' THEN ' | [Nhà xuất bản: ' || publisher || ']' ELSE '' END
   || CASE WHEN coalesce(aw, 0) <> 0 THEN ' | [Độ dài tác phẩm: ~' || aw || ' từ]' ELSE '' END || chr(10) || chr(10) || 'Nội dung chi tiết:' || chr(10) || summary AS full_text FROM v),
 x AS (SELECT *, CASE WHEN length(full_text) > 3000 THEN substr(full_text, 1, 3000) || '...' ELSE full_text END AS text FROM t)
SELECT {S.uuid5('key', uuid.NAMESPACE_OID.hex)} AS chunk_id, md5(text) AS text_md5, {S.word_count('text')} AS word_count, length(text) AS char_count, title, au AS author, year,
 CASE WHEN genre <> '' THEN genre ELSE gs END AS genre, publisher, source FROM x"""


def _catalogue(spark, d) -> DataFrame:
    return entity.catalogue(records(spark, d))


def entity_catalogue(spark, d):
    c = _catalogue(spark, d)
    return c.select("id", "title", "entity_type", "author", "publication_year", "genre", "publisher", "page_count", "isbn",
                    F.md5("summary").alias("summary_md5"), "source", "first_record", "n_paths")


_CATALOGUE = f"""{RECORDS}, k AS (SELECT *, lower(title) || ' | ' || lower(author) AS key FROM r WHERE title <> ''),
 cat AS (SELECT key, arg_min(title, path) AS title, arg_min(author, path) AS author,
  coalesce(arg_min(publication_year, path) FILTER (publication_year <> ''), '') AS publication_year,
  coalesce(arg_min(genre, path) FILTER (genre <> ''), '') AS genre, coalesce(arg_min(publisher, path) FILTER (publisher <> ''), '') AS publisher,
  coalesce(arg_min(page_count, path) FILTER (page_count NOT IN ('', '0')), '') AS page_count, '' AS isbn, '' AS cover_url,
  arg_min({S.strip('summary')}, (-length({S.strip('summary')}), path)) AS summary,
  array_to_string(list_sort(list(DISTINCT src)), ', ') AS source, min(path) AS first_record, count(*) AS n_paths FROM k GROUP BY key)"""
SQL_CATALOGUE = f"""
WITH {_CATALOGUE} SELECT {S.uuid5('key', uuid.NAMESPACE_OID.hex)} AS id, title, 'work' AS entity_type, author, publication_year, genre, publisher, page_count, isbn,
 md5(summary) AS summary_md5, source, first_record, n_paths FROM cat"""


def entity_paths(spark, d):
    return entity.entity_paths(records(spark, d)).select("id", "path")


SQL_PATHS = f"WITH {_CATALOGUE} SELECT {S.uuid5('key', uuid.NAMESPACE_OID.hex)} AS id, path FROM k"


def fill_rates(spark, d):
    return quality.fill_rate(_catalogue(spark, d))


def _filled(f: str) -> str:
    return f"length({S.strip(f)}) >= 50" if f == "summary" else f"{S.strip(f)} <> ''"


SQL_FILL = f"WITH {_CATALOGUE} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({_filled(f)}) AS filled, count(*) AS total, round(count(*) FILTER ({_filled(f)}) * 100.0 / count(*), 1) AS pct FROM cat" for f in V.FILLABLE_FIELDS)


def _enriched(spark, d) -> DataFrame:
    """Catalogue rows with values suggested for their gaps (here from the row itself)."""
    suggestions = F.create_map(
        F.lit("publication_year"), F.concat(F.lit("khoảng "), (F.lit(1450) + F.length("title")).cast("string")),
        F.lit("genre"), F.when(F.length("title") % 3 == 0, F.lit("N/A")).otherwise(F.lit("Thơ")),
        F.lit("page_count"), F.length("summary").cast("string"))
    return enrich.enrich(_catalogue(spark, d), suggestions)


_ENRICHED = f"""{_CATALOGUE}, en AS (SELECT * REPLACE (
   CASE WHEN publication_year <> '' THEN publication_year WHEN length(title) >= 50 AND 1450 + length(title) < 2030 THEN CAST(1450 + length(title) AS VARCHAR) ELSE '' END AS publication_year,
   CASE WHEN genre <> '' THEN genre WHEN length(title) % 3 = 0 THEN '' ELSE 'Thơ' END AS genre, CASE WHEN page_count <> '' THEN page_count ELSE CAST(length(summary) AS VARCHAR) END AS page_count),
   array_to_string([x FOR x IN [CASE WHEN publication_year = '' AND length(title) >= 50 AND 1450 + length(title) < 2030 THEN 'publication_year' END, CASE WHEN genre = '' AND length(title) % 3 <> 0 THEN 'genre' END,
     CASE WHEN page_count = '' THEN 'page_count' END] IF x IS NOT NULL], ',') AS ai_filled FROM cat)"""


def enriched_rows(spark, d):
    return _enriched(spark, d).groupBy("ai_filled").agg(F.count(F.lit(1)).alias("n"))


SQL_ENRICHED = f"WITH {_ENRICHED} SELECT ai_filled, count(*) AS n FROM en GROUP BY 1"


def missing_field_lists(spark, d):
    m = F.array_join(enrich.missing_fields(), ",")
    return _catalogue(spark, d).groupBy(m.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


SQL_MISSING = f"WITH {_CATALOGUE} SELECT array_to_string([x FOR x IN [" + ", ".join(
    f"CASE WHEN {f} = '' THEN '{f}' END" for f in V.ENRICH_FIELDS) + "] IF x IS NOT NULL], ',') AS missing, count(*) AS n FROM cat GROUP BY 1"


def fill_before_after(spark, d):
    return quality.before_after(_enriched(spark, d))


def _before_after(f: str) -> str:
    ok, ai = _filled(f), f"{_filled(f)} AND list_contains(string_split(ai_filled, ','), '{f}')"
    return (f"SELECT '{f}' AS field, count(*) FILTER ({ok}) - count(*) FILTER ({ai}) AS before, count(*) FILTER ({ok}) AS after, count(*) FILTER ({ai}) AS added, "
            f"round((count(*) FILTER ({ok}) - count(*) FILTER ({ai})) * 100.0 / count(*), 1) AS before_pct, round(count(*) FILTER ({ok}) * 100.0 / count(*), 1) AS after_pct FROM en")


SQL_BEFORE = f"WITH {_ENRICHED} " + " UNION ALL ".join(_before_after(f) for f in V.REPORT_FIELDS)


def fill_latex(spark, d):
    return latex_fill_rows(fill_before_after(spark, d))


_PCT = "replace(format('{:.1f}', %s), '.', '{,}')"
SQL_LATEX = f"""WITH ba AS ({SQL_BEFORE}) SELECT field, replace(field, '_', '\\_') || ' & $' || {_PCT % 'before_pct'} || '\\%$ & $' || {_PCT % 'after_pct'} || '\\%$ & '
 || replace(format('{{:,}}', added), ',', '.') || ' \\\\' AS latex FROM ba"""


def write_back(spark, d):
    rows = _enriched(spark, d).join(entity.entity_paths(records(spark, d)).select("id", "record_id"), "id")
    done = enrich.write_back(records(spark, d), rows)
    return enrich.write_back_summary(done)


_CH = {"author": "r.author = '' AND en.author <> ''", "publication_year": "r.publication_year = '' AND en.publication_year <> ''",
       "genre": "r.genre = '' AND en.genre <> ''", "publisher": "r.publisher = '' AND en.publisher <> ''",
       "page_count": "r.page_count IN ('', '0') AND en.page_count <> ''"}
SQL_WRITE = f"WITH {_ENRICHED}, j AS (SELECT " + ", ".join(f"CAST(coalesce({c}, false) AS BIGINT) AS {f}" for f, c in _CH.items()) + \
    " FROM r LEFT JOIN k ON k.path = r.path LEFT JOIN en ON en.key = k.key) SELECT " + \
    f"count(*) FILTER ({' + '.join(_CH)} > 0) AS files, CAST(sum({' + '.join(_CH)}) AS BIGINT) AS fields_written, " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in _CH) + " FROM j"


def card_originals(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("file_name"), F.col("text").alias("content"))
    cards = load(spark, d, "labels", "doc_id").select(F.explode(F.array("doc_id", -F.col("doc_id"))).alias("file_name"), F.lit("card").alias("content"))
    j = enrich.original_text(cards, docs)
    return j.select("file_name", F.length("full_text").cast("long").alias("chars"))


SQL_ORIGINALS = """
WITH c AS (SELECT doc_id AS f FROM labels UNION ALL SELECT -doc_id FROM labels)
SELECT f AS file_name, CASE WHEN coalesce(d.text, '') <> '' THEN length(d.text) ELSE 4 END AS chars FROM c LEFT JOIN documents d ON d.doc_id = c.f"""


def summary_todo(spark, d):
    r = records(spark, d).withColumn("ai_summary", F.col("content"))
    return r.groupBy("folder", enrich.needs_summary().alias("todo")).agg(F.count(F.lit(1)).alias("n"))


SQL_TODO = f"WITH {RECORDS} SELECT folder, length({S.strip('content')}) < 150 OR genre = '' AS todo, count(*) AS n FROM r GROUP BY 1, 2"


# ------------------------------------------------------------------ incremental
def remaining_documents(spark, d):
    left = keyed.not_done(load(spark, d, "documents", "doc_id", "lang"), load(spark, d, "labels", "doc_id"), "doc_id")
    done = keyed.already_done(load(spark, d, "documents", "doc_id", "lang"), load(spark, d, "labels", "doc_id"), "doc_id")
    both = left.withColumn("done", F.lit(0).cast("long")).unionAll(done.withColumn("done", F.lit(1).cast("long")))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("done").alias("n_done"))


SQL_REMAINING = "SELECT lang, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_done FROM documents GROUP BY 1"


def latest_upserts(spark, d):
    e = load(spark, d, "events", "user_id", "event_id", "event_type", "value")
    return keyed.upsert(e, e.withColumn("value", F.col("value") + 1), "user_id", "event_id")


SQL_UPSERT = "SELECT user_id, event_id, event_type, value + 1 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


# ------------------------------------------------------------------ coverage
def _canon(spark, d) -> DataFrame:
    c = load(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("canon_id"), F.col("text").alias("title"))
    docs = load(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("position"), F.col("text").alias("title"))
    return canon.match_titles(c, docs)


def title_matches(spark, d):
    return _canon(spark, d)


_MATCH = f"""c AS (SELECT item_id AS canon_id, {S.audit_norm('text')} AS c FROM benchmark), t AS (SELECT doc_id, text, lang, source, {S.audit_norm('text')} AS t FROM documents),
 ex AS (SELECT canon_id, min(doc_id) AS p FROM c JOIN t ON c.c = t.t GROUP BY 1),
 ct AS (SELECT canon_id, min(doc_id) AS p FROM c JOIN t ON t.t <> '' AND length(c.c) >= 4 AND (contains(' '||t.t||' ', ' '||c.c||' ') OR contains(' '||c.c||' ', ' '||t.t||' ')) GROUP BY 1),
 m AS (SELECT c.canon_id, coalesce(ex.p, ct.p) AS position, CASE WHEN ex.p IS NOT NULL THEN 'exact' WHEN ct.p IS NOT NULL THEN 'contains' ELSE 'missing' END AS how
  FROM c LEFT JOIN ex USING (canon_id) LEFT JOIN ct USING (canon_id))"""
SQL_MATCH = f"WITH {_MATCH} SELECT * FROM m"


def coverage_audit(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "n_chars").select(
        F.col("doc_id").alias("position"), "text", F.when(F.col("n_chars") % 4 == 0, F.lit(" ")).otherwise(F.col("lang")).alias("author"))
    return canon.coverage_summary(_canon(spark, d), canon.quality_flags(docs))


_HAS_YEAR = r"regexp_matches(text, '(?:\A|[^\p{L}\p{N}_])(1[5-9][0-9]{2}|20[0-2][0-9])(?:[^\p{L}\p{N}_]|\z)')"
SQL_COVERAGE = f"""WITH {_MATCH}, f AS (SELECT doc_id, n_chars % 4 = 0 OR NOT {_HAS_YEAR} OR length({S.strip('text')}) < 200 AS thin FROM documents)
SELECT count(*) AS canon_total, count(position) AS present, count(*) FILTER (position IS NULL) AS missing, count(*) FILTER (thin) AS thin,
 round(count(position) * 100.0 / count(*), 0) AS coverage_pct FROM m LEFT JOIN f ON f.doc_id = m.position"""


def audit_flags(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "n_chars").withColumn("author", F.when(F.col("n_chars") % 4 == 0, F.lit(" ")).otherwise(F.col("lang")))
    f = canon.quality_flags(docs)
    return f.groupBy("lang").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("missing_author", "missing_year", "junk_summary")])


SQL_FLAGS = f"SELECT lang, count(*) FILTER (n_chars % 4 = 0) AS missing_author, count(*) FILTER (NOT {_HAS_YEAR}) AS missing_year, count(*) FILTER (length({S.strip('text')}) < 200) AS junk_summary FROM documents GROUP BY 1"


def first_positions(spark, d):
    """Distinct sources with the place of their first document."""
    return keyed.order_preserving_distinct(load(spark, d, "documents", "doc_id", "source"), "source", "doc_id")


SQL_POSITIONS = "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1"


def stored_vectors(spark, d):
    """Vectors and their payload stored apart, met again key by key, and the payload scanned alone."""
    base = f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/vectors-{uuid.uuid4().hex}"
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label")
    e.select("vec_id", "embedding").write.parquet(f"{base}/vectors")
    e.select("vec_id", "label", F.lit(None).cast("array<float>").alias("embedding")).write.parquet(f"{base}/payload")
    both = readers.read_vectors(spark, f"{base}/vectors", f"{base}/payload", "vec_id", readers.read_payload(spark, f"{base}/payload"))
    return both.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


SQL_STORED_VECTORS = "SELECT vec_id, label, len(embedding) AS dim FROM embeddings"


def article_round_trip(spark, d):
    """documents -> articles -> cleaned, written, read again -> one entity per title; the chain of the command line."""
    base = f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/chain-{uuid.uuid4().hex}"
    docs = load(spark, d, "documents", "doc_id", "text", "source")
    raw = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("T"), F.col("source")).alias("title"), F.lit("").alias("url"),
                      F.when(F.col("doc_id") % 2 == 0, V.WORK_CATEGORIES[0]).otherwise(V.AUTHOR_CATEGORIES[0]).alias("category"),
                      F.array("source").alias("categories"), F.col("text").alias("content"), F.lit("vi").alias("language"),
                      F.lit("").alias("crawled_at"), F.lit("").alias("last_modified"), F.col("doc_id").cast("string").alias("path"))
    write_records(ingest.clean_articles(raw), base, by="type")
    again = readers.read_source_folders(spark, base, ["work", "author"])
    return entity.catalogue(again).select("title", "source", F.col("n_paths").alias("n"))


SQL_ROUND_TRIP = f"""WITH c AS (SELECT 'T' || source AS title, CASE WHEN doc_id % 2 = 0 THEN 'wikipedia' ELSE 'unknown' END AS src, length({sql_cut()}) AS chars FROM documents)
SELECT title, array_to_string(list_sort(list(DISTINCT src)), ', ') AS source, count(*) AS n FROM c WHERE chars >= {V.MIN_CLEAN_CHARS} GROUP BY 1"""


ENTRIES = {
    "first_positions": (first_positions, SQL_POSITIONS),
    "stored_vectors": (stored_vectors, SQL_STORED_VECTORS),
    "article_round_trip": (article_round_trip, SQL_ROUND_TRIP),
    "book_funnel": (book_funnel, SQL_FUNNEL),
    "topic_filter": (topic_filter, SQL_TOPIC),
    "category_filter": (category_filter, SQL_CATEGORIES),
    "category_types": (category_types, SQL_TYPES),
    "first_copies": (first_copies, SQL_FIRST),
    "longest_copies": (longest_copies, SQL_LONGEST),
    "entity_chunks": (entity_chunks, SQL_ENTITY),
    "entity_catalogue": (entity_catalogue, SQL_CATALOGUE),
    "entity_paths": (entity_paths, SQL_PATHS),
    "fill_rates": (fill_rates, SQL_FILL),
    "enriched_rows": (enriched_rows, SQL_ENRICHED),
    "missing_field_lists": (missing_field_lists, SQL_MISSING),
    "fill_before_after": (fill_before_after, SQL_BEFORE),
    "fill_latex": (fill_latex, SQL_LATEX),
    "write_back": (write_back, SQL_WRITE),
    "card_originals": (card_originals, SQL_ORIGINALS),
    "summary_todo": (summary_todo, SQL_TODO),
    "remaining_documents": (remaining_documents, SQL_REMAINING),
    "latest_upserts": (latest_upserts, SQL_UPSERT),
    "title_matches": (title_matches, SQL_MATCH),
    "coverage_audit": (coverage_audit, SQL_COVERAGE),
    "audit_flags": (audit_flags, SQL_FLAGS),
}
