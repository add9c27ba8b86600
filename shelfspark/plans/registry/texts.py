"""Cleaning, measuring and extracting from texts and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions import extract as X
from shelfspark.functions import text as T
from shelfspark.functions.fold import audit_norm, tokenize
from shelfspark.functions.ids import archive_id, drive_direct_url, safe_name, uuid5
from shelfspark.functions.pages import page_parts
from shelfspark.operators.keyed import most_common
from shelfspark.plans.ingest import cleaned_texts
from shelfspark.operators import canon
from shelfspark.plans.registry import sql as S
from shelfspark.plans.stories import assemble_stories
from shelfspark.session import explode_once
from shelfspark.sources.tables import load

_NL = "chr(10)"


# ------------------------------------------------------------------ cleaning
def clean_article_text(spark, d):
    c = cleaned_texts(load(spark, d, "documents", "doc_id", "text"), "text", "doc_id")
    return c.select("doc_id", F.md5("content").alias("content_md5"), T.char_count("content").alias("char_count"),
                    T.word_count("content").alias("word_count"))


def sql_cut() -> str:
    x = "text"
    for name in V.JUNK_SECTIONS:
        x = f"regexp_replace({x}, '(?ms)^=+[{S.WS}]*{name}[{S.WS}]*=+.*', '')"
    x = f"regexp_replace({x}, '(?m)^=+[^=]+=+[{S.WS}]*$', '', 'g')"
    return S.strip(f"regexp_replace({x}, '\\n{{3,}}', {_NL}||{_NL}, 'g')")


SQL_CLEAN = f"""
WITH c AS (SELECT doc_id, {sql_cut()} AS c FROM documents)
SELECT doc_id, md5(c) AS content_md5, length(c) AS char_count, {S.word_count('c')} AS word_count
FROM c WHERE length(c) >= 50"""


def lead_paragraphs(spark, d):
    s = load(spark, d, "documents", "doc_id", "text").select("doc_id", T.lead_lines("text").alias("s"))
    return s.select("doc_id", F.md5("s").alias("summary_md5"), T.char_count("s").alias("summary_chars"))


SQL_LEAD = f"""
WITH l AS (SELECT doc_id, array_to_string(list_slice([s FOR s IN [{S.strip('x')} FOR x IN string_split(text, {_NL})] IF s <> ''], 1, 3), {_NL}) AS s
  FROM documents)
SELECT doc_id, md5(s) AS summary_md5, length(s) AS summary_chars FROM l"""


def clean_description(spark, d):
    return (load(spark, d, "documents", "doc_id", "text").withColumn("c", T.clean_book_text("text"))
            .select("doc_id", F.md5("c").alias("content_md5"), T.word_count("c").alias("word_count"), T.char_count("c").alias("char_count")))


SQL_DESC = f"""
WITH c AS (SELECT doc_id, {S.strip(f"regexp_replace(regexp_replace(regexp_replace(text, '[{chr(92)}x00-{chr(92)}x08{chr(92)}x0b-{chr(92)}x0c{chr(92)}x0e-{chr(92)}x1f{chr(92)}x7f]', '', 'g'), '[ {chr(92)}t]+', ' ', 'g'), '{chr(92)}n{{3,}}', {_NL}||{_NL}, 'g')")} AS c FROM documents)
SELECT doc_id, md5(c) AS content_md5, {S.word_count('c')} AS word_count, length(c) AS char_count FROM c"""


def book_cards(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "source").withColumn("wc", T.word_count("text"))
    return docs.select("doc_id", T.book_card("source", "lang", "wc", "text").alias("card"))


SQL_CARDS = f"""
WITH w AS (SELECT *, {S.word_count('text')} AS wc, {S.excerpt('text')} AS ex FROM documents)
SELECT doc_id, 'Tác phẩm: ' || source || chr(10) || 'Tác giả: ' || lang || chr(10) || 'Độ dài: ' || format('{{:,}}', wc) || ' từ (' || {S.page_band('wc')} || ')' || chr(10)
 || 'Ngôn ngữ: Tiếng Việt' || chr(10) || 'Nguồn: Kho lưu trữ văn học (archive)' || CASE WHEN ex <> '' THEN chr(10) || 'Trích đoạn mở đầu: ' || ex ELSE '' END AS card
FROM w"""


def page_bands(spark, d):
    docs = load(spark, d, "documents", "text").select(T.page_band(T.word_count("text")).alias("band"))
    return docs.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


SQL_BANDS = f"""
SELECT band, count(*) AS n FROM (SELECT {S.page_band('w')} AS band FROM (SELECT {S.word_count('text')} AS w FROM documents)) GROUP BY 1"""


def body_excerpts(spark, d):
    e = load(spark, d, "documents", "doc_id", "text").select("doc_id", T.body_excerpt("text").alias("e"))
    return e.select("doc_id", F.md5("e").alias("excerpt_md5"), T.char_count("e").alias("excerpt_chars"))


SQL_EXCERPTS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 t AS (SELECT doc_id, i, {S.strip('raw')} AS s FROM l),
 o AS (SELECT doc_id, min(i) AS o FROM t WHERE length(s) >= 60 GROUP BY 1),
 c AS (SELECT t.*, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM t JOIN o USING (doc_id) WHERE i >= o),
 b AS (SELECT doc_id, {S.strip("string_agg(s, chr(10) ORDER BY i)")} AS b FROM c WHERE before < 3000 GROUP BY doc_id),
 e AS (SELECT d.doc_id, substr(CASE WHEN coalesce(b.b, '') <> '' THEN b.b ELSE d.text END, 1, 3000) AS e FROM documents d LEFT JOIN b USING (doc_id))
SELECT doc_id, md5(e) AS excerpt_md5, length(e) AS excerpt_chars FROM e"""


def display_snippets(spark, d):
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.clean_snippet("text").alias("snippet"))


SQL_SNIPPET = f"""
WITH b AS (SELECT doc_id, {S.strip("CASE WHEN contains(text, 'Nội dung chi tiết:') THEN substr(text, instr(text, 'Nội dung chi tiết:') + 18) WHEN contains(text, chr(10)||chr(10)) THEN substr(text, instr(text, chr(10)||chr(10)) + 2) ELSE text END")} AS b FROM documents)
SELECT doc_id, CASE WHEN length(b) > 150 THEN substr(b, 1, 150) || '…' ELSE b END AS snippet FROM b"""


# ------------------------------------------------------------------ tokens
def frequent_tokens(spark, d):
    t = explode_once(load(spark, d, "documents", "text"), tokenize("text"), "token")
    return most_common(t, "token", 50)


SQL_TOKENS = f"""
SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 50"""


def audit_titles(spark, d):
    p = load(spark, d, "part", "p_name", "p_type")
    b = load(spark, d, "benchmark", "item_id", "text")
    t = p.select(F.concat_ws(" - ", "p_name", "p_type").alias("t")).unionAll(b.select("text"))
    return t.groupBy(audit_norm("t").alias("norm")).agg(F.count(F.lit(1)).alias("n"))


SQL_AUDIT_TITLES = f"""
SELECT {S.audit_norm('t')} AS norm, count(*) AS n FROM (SELECT p_name || ' - ' || p_type AS t FROM part UNION ALL SELECT text FROM benchmark) GROUP BY 1"""


# ------------------------------------------------------------------ extraction
def content_years(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", X.year_modern("text").alias("modern"), X.year_infobox("text").alias("infobox"),
                       X.year_strict("text").alias("strict"))


def _sql_year(p: str) -> str:
    # The boundary is written out: a letter with an accent belongs to a word.
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_extract(text, '(?:\\A|{edge})({p})(?:{edge}|\\z)', 1)"


SQL_YEARS = f"""
SELECT doc_id, {_sql_year('(?:19|20)[0-9]{2}')} AS modern, {_sql_year('1[0-9]{3}|20[0-9]{2}')} AS infobox,
 {_sql_year('1[5-9][0-9]{2}|20[0-2][0-9]')} AS strict FROM documents"""


def genre_names(spark, d):
    g = load(spark, d, "documents", "doc_id", "text").select("doc_id", X.normalize_genre("text").alias("g"), F.length("text").alias("n"))
    known = F.col("g").isin(*sorted({label for _, label in V.GENRE_PATTERNS}), V.OTHER_GENRE)
    return g.groupBy(F.when(known, F.col("g")).otherwise("(own name)").alias("genre")).agg(F.count(F.lit(1)).alias("n"))


def _sql_genre() -> str:
    whens = " ".join(f"WHEN contains(t, {S.q(a)}) THEN {S.q(b)}" for a, b in V.GENRE_PATTERNS)
    return f"CASE {whens} WHEN regexp_matches(t, '[{V.VIETNAMESE_LETTERS}]') THEN '(own name)' ELSE 'Khác' END"


SQL_GENRE = f"SELECT {_sql_genre()} AS genre, count(*) AS n FROM (SELECT lower(text) AS t FROM documents) GROUP BY 1"


def mapped_genres(spark, d):
    raw = F.concat_ws(" / ", F.col("p_type"), F.element_at(F.array(*[F.lit(g) for g, _ in V.BOOK_GENRE_MAP], F.lit("General")),
                                                          (F.col("p_size") % 12 + 1).cast("int")))
    return (load(spark, d, "part", "p_type", "p_size").select(X.map_book_genre(raw).alias("genre"))
            .groupBy("genre").agg(F.count(F.lit(1)).alias("n")))


_GENRE_LIST = "[" + ", ".join(S.q(g) for g, _ in V.BOOK_GENRE_MAP) + ", 'General']"
SQL_MAPPED = f"""
WITH r AS (SELECT p_type || ' / ' || ({_GENRE_LIST})[p_size % 12 + 1] AS raw FROM part)
SELECT CASE {" ".join(f"WHEN contains(lower(raw), {S.q(a)}) THEN {S.q(b)}" for a, b in V.BOOK_GENRE_MAP)} ELSE raw END AS genre, count(*) AS n FROM r GROUP BY 1"""


def infobox_fields(spark, d):
    wikitext = F.concat(F.lit("{{Infobox book\n| tác giả = [["), "p_brand", F.lit("]]\n| published = spring of "),
                        (F.lit(1950) + F.col("p_size")).cast("string"), F.lit("\n| thể loại = '''"), "p_type", F.lit("'''<br>\n| author = other\n| pages = 10\n}}"))
    box = load(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size").select("p_partkey", X.parse_infobox(wikitext).alias("b"))
    return box.select("p_partkey", *[F.coalesce(F.try_element_at("b", F.lit(k)), F.lit("")).alias(k) for k in ("author", "publication_year", "genre")],
                      F.size("b").cast("long").alias("n_fields"))


SQL_INFOBOX = "SELECT p_partkey, p_brand AS author, CAST(1950 + p_size AS VARCHAR) AS publication_year, p_type AS genre, CAST(3 AS BIGINT) AS n_fields FROM part"


def text_fallbacks(spark, d):
    content = F.concat(F.lit("Đây là tiểu thuyết của Nam "), F.initcap("p_name"), F.lit(", xuất bản năm "), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit("\n"), "p_type")
    t = load(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size").select("p_partkey", content.alias("c"), F.array("p_type").alias("cats"))
    return t.select("p_partkey", X.content_author("c").alias("author"), X.content_year("c").alias("year"),
                    X.content_genre("c", "cats")["genre"].alias("genre"), X.content_genre("c", "cats")["genre_source"].alias("genre_source"))


SQL_FALLBACKS = """
SELECT p_partkey, 'Nam ' || array_to_string([upper(substr(w,1,1)) || lower(substr(w,2)) FOR w IN string_split(p_name, ' ')], ' ') AS author,
 CAST(1950 + p_size AS VARCHAR) AS year, 'Tiểu thuyết' AS genre, 'regex' AS genre_source FROM part"""


def article_kinds(spark, d):
    head = F.concat(F.lit("Nội dung. "), F.when(F.col("p_size") % 3 == 0, F.lit("Ông là một nhà văn lớn. ")).when(
        F.col("p_size") % 3 == 1, F.lit("Ông sinh năm 1930. ")).otherwise(F.lit("Sách in. ")), F.col("p_name"))
    p = load(spark, d, "part", "p_name", "p_type", "p_size")
    kind = X.classify_article(F.array("p_type"), head, F.col("p_type"), ("ECONOMY",))
    entity = X.classify_entity(F.array("p_type"), head)
    return p.groupBy(kind.alias("kind"), entity.alias("entity")).agg(F.count(F.lit(1)).alias("n"))


SQL_KINDS = """
SELECT CASE WHEN p_type = 'ECONOMY' OR p_size % 3 < 2 THEN 'author' ELSE 'book' END AS kind,
 CASE WHEN p_size % 3 = 0 THEN 'author' ELSE 'work' END AS entity, count(*) AS n FROM part GROUP BY 1, 2"""


def answer_objects(spark, d):
    text = F.concat(F.lit("Answer: "), "props", F.lit(" done"))
    e = load(spark, d, "events", "event_type", "props").select("event_type", X.json_object(text).alias("o"))
    return e.groupBy("event_type").agg(F.count(F.try_element_at("o", F.lit("k"))).alias("n"),
                                       F.sum(F.try_element_at("o", F.lit("k")).cast("long")).alias("total"))


SQL_OBJECTS = "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1"


def answer_lists(spark, d):
    raw = F.concat(F.lit('Some ideas: ["'), "p_name", F.lit('", "'), "p_brand", F.lit('"] end'))
    p = load(spark, d, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", X.json_list(raw).alias("l"))
    return p.select("p_partkey", F.array_join("l", "|").alias("items"), F.size("l").cast("long").alias("n"))


SQL_LISTS = "SELECT p_partkey, p_name || '|' || p_brand AS items, CAST(2 AS BIGINT) AS n FROM part"


def labelled_answers(spark, d):
    raw = F.concat(F.lit("Thể loại: "), "p_type", F.lit("\n Đối tượng: "), "p_brand", F.lit(" \nTóm tắt: "), "p_name", F.lit(": x"))
    a = X.parse_summary_answer(raw)
    return load(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", a["genre"].alias("genre"), a["audience"].alias("audience"), a["summary"].alias("summary"))


SQL_LABELLED = "SELECT p_partkey, p_type AS genre, p_brand AS audience, p_name || ': x' AS summary FROM part"


def canon_pairs(spark, d):
    block = F.concat(F.lit("**Heading** "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit("), "), F.col("p_type"), F.lit(" (x)"))
    p = load(spark, d, "part", "p_name", "p_brand", "p_type").select(F.explode(X.canon_pairs(block)).alias("c")).select("c.*")
    return p.groupBy("title", "author").agg(F.count(F.lit(1)).alias("n"))


SQL_CANON = "SELECT title, author, count(*) AS n FROM (SELECT p_name AS title, p_brand AS author FROM part UNION ALL SELECT p_type, 'x' FROM part) GROUP BY 1, 2"


def expected_titles(spark, d):
    """Titles of parts and of their kinds as one list of items per part; each normalised title once."""
    block = F.concat(F.lit("**Heading** "), F.upper("p_type"), F.lit(" (x), "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit("), "), F.col("p_type"), F.lit(" (y)"))
    return canon.expected_titles(load(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type").withColumn("block", block), "block", "p_partkey")


SQL_EXPECTED = f"""SELECT title, author FROM (SELECT title, author, p_partkey, place, {S.audit_norm('title')} AS norm FROM (SELECT p_partkey, 0 AS place, upper(p_type) AS title, 'x' AS author FROM part
 UNION ALL SELECT p_partkey, 1, p_name, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_type, 'y' FROM part))
WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm ORDER BY p_partkey, place) = 1"""


def summary_cards(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "source").withColumn("wc", T.word_count("text"))
    genre = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit(""))
    author = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("lang"))
    return docs.select("doc_id", F.md5(T.summary_card(F.col("source"), author, F.col("wc"), F.col("text"), genre, F.lit("ai cũng đọc được"))).alias("card_md5"))


SQL_SUMMARY_CARDS = f"""
WITH w AS (SELECT *, {S.word_count('text')} AS wc FROM documents)
SELECT doc_id, md5('Tác phẩm: ' || source || chr(10) || 'Tác giả: ' || CASE WHEN doc_id % 5 = 0 THEN '{V.UNKNOWN_AUTHOR}' ELSE lang END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Thể loại: ' || lang ELSE '' END
 || chr(10) || 'Đối tượng: ai cũng đọc được' || chr(10) || 'Độ dài: ' || format('{{:,}}', wc) || ' từ (' || {S.page_band('wc')} || ')' || chr(10)
 || 'Ngôn ngữ: Tiếng Việt' || chr(10) || 'Nguồn: Kho lưu trữ văn học (archive)' || chr(10) || 'Tóm tắt: ' || text) AS card_md5 FROM w"""


def header_tags(spark, d):
    """Values read back out of headers made from the rows."""
    head = F.concat(F.lit("[Tiêu đề: "), F.col("p_name"), F.lit("] | [Năm xuất bản:  "), F.col("p_size").cast("string"), F.lit("]\n\n"), F.col("p_type"))
    p = load(spark, d, "part", "p_partkey", "p_name", "p_size", "p_type").withColumn("head", head)
    return p.select("p_partkey", X.tag_value("head", "Tiêu đề").alias("title"), X.tag_value("head", "Năm xuất bản").alias("year"), X.tag_value("head", "Tác giả").alias("author"))


SQL_HEADER_TAGS = "SELECT p_partkey, trim(p_name) AS title, CAST(p_size AS VARCHAR) AS year, '' AS author FROM part"


def suggested_values(spark, d):
    field = F.element_at(F.array(F.lit("publication_year"), F.lit("genre")), (F.col("p_size") % 2 + 1).cast("int"))
    value = F.when(F.col("p_size") % 5 == 0, F.lit(" N/A ")).when(F.col("p_size") % 2 == 0, F.concat(F.lit("năm "), (F.lit(1480) + F.col("p_size")).cast("string"))).otherwise(F.col("p_type"))
    p = load(spark, d, "part", "p_size", "p_type").select(field.alias("field"), X.clean_suggested_value(field, value).alias("v"))
    return p.groupBy("field", F.coalesce("v", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


SQL_SUGGESTED = """
SELECT CASE WHEN p_size % 2 = 0 THEN 'publication_year' ELSE 'genre' END AS field,
 CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN CASE WHEN 1480 + p_size >= 1500 THEN CAST(1480 + p_size AS VARCHAR) ELSE '' END ELSE p_type END AS value,
 count(*) AS n FROM part GROUP BY 1, 2"""


def isbn_choice(spark, d):
    ten = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    many = F.when(F.col("p_size") % 3 == 0, F.array(ten)).when(F.col("p_size") % 3 == 1, F.array(ten, F.concat(F.lit("978"), ten))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "part", "p_partkey", "p_size").select("p_partkey", X.pick_isbn(many).alias("isbn"))


SQL_ISBN = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 10, '0') WHEN p_size % 3 = 1 THEN '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE '' END AS isbn FROM part"


# ------------------------------------------------------------------ ids and names
def name_ids(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text", "lang", "source")
    return docs.select("doc_id", uuid5("text").alias("oid_uuid"), archive_id("source", "lang").alias("archive_uuid"))


SQL_IDS = f"""
SELECT doc_id, {S.uuid5('text', uuid.NAMESPACE_OID.hex)} AS oid_uuid, {S.uuid5("'archive-' || source || '-' || lang", uuid.NAMESPACE_URL.hex)} AS archive_uuid FROM documents"""


def file_names(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.concat(safe_name("text"), F.lit(" - "), F.lit(V.UNKNOWN_AUTHOR), F.lit(".txt")).alias("file_name"))


SQL_NAMES = f"""SELECT doc_id, substr({S.strip(f"regexp_replace(text, '[{chr(92)*2}/:*?" + '"' + "<>|]', '', 'g')")}, 1, 150) || ' - Khuyết danh.txt' AS file_name FROM documents"""


def direct_urls(spark, d):
    shared = F.concat(F.lit("https://drive.google.com/file/d/"), F.col("page_id").cast("string"), F.lit("/view"))
    u = load(spark, d, "pages", "page_id", "url").select("page_id", F.explode(F.array("url", shared)).alias("u"))
    return u.select("page_id", drive_direct_url("u").alias("url"))


SQL_URLS = "SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://drive.google.com/uc?export=download&id=' || page_id FROM pages"


# ------------------------------------------------------------------ pages
def web_pages(spark, d):
    pages = load(spark, d, "pages", "page_id", "html")
    p = page_parts("html", content=("article",), titles=("h1",), link_pattern="^/", base_url="http://site.test")
    return pages.select("page_id", p.alias("p")).select(
        "page_id", "p.title", F.md5("p.content").alias("content_md5"), F.length("p.content").cast("long").alias("content_chars"),
        F.array_join("p.links", " ").alias("links"))


def _sql_page_text(x: str) -> str:
    parts = f"[{S.strip('s')} FOR s IN regexp_split_to_array({x}, '<[^>]*>')]"
    text = f"array_to_string([s FOR s IN {parts} IF s <> ''], chr(10))"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


_PAGE_BODY = r"regexp_extract(html, '(?s)<article>(.*?)(</article>|\z)', 1)"
for _tag in V.STRIPPED_ELEMENTS:
    _PAGE_BODY = f"regexp_replace({_PAGE_BODY}, '(?s)<{_tag}[ >].*?</{_tag}>', '', 'g')"
SQL_PAGES = f"""
WITH p AS (SELECT page_id, html, regexp_replace({_PAGE_BODY}, '(?s)<!--.*?-->', '', 'g') AS body FROM pages),
 x AS (SELECT page_id, replace({_sql_page_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")}, chr(10), ' ') AS h1, {_sql_page_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t,
   {_sql_page_text('body')} AS c, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM p)
SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE t END AS title, md5(CASE WHEN length(c) > 100 THEN c ELSE '' END) AS content_md5,
 length(CASE WHEN length(c) > 100 THEN c ELSE '' END) AS content_chars,
 coalesce(array_to_string([u FOR u, i IN ['http://site.test' || h FOR h IN hrefs IF starts_with(h, '/')] IF list_position(['http://site.test' || h FOR h IN hrefs IF starts_with(h, '/')], u) = i], ' '), '') AS links
FROM x"""


def chapter_texts(spark, d):
    """The pages as chapters of books of five, linked last first from book pages, those from one listing."""
    p = load(spark, d, "pages", "page_id", "html")
    book = F.floor(F.col("page_id") / 5).cast("long")
    site = "http://site.test/truyen.aspx?tid="
    chapters = p.select(F.concat(F.lit(site), book.cast("string"), F.lit("&chuong="), F.col("page_id").cast("string")).alias("url"), "html")
    link = F.concat(F.lit('<a href="/truyen.aspx?tid='), book.cast("string"), F.lit("&amp;chuong="), F.col("page_id").cast("string"), F.lit('">x</a>'))
    links = p.groupBy(book.alias("b")).agg(F.sort_array(F.collect_list(F.struct("page_id", link.alias("a"))), asc=False).alias("l"))
    body = F.concat(F.lit("<h1>Book "), F.col("b").cast("string"), F.lit("</h1>"), F.array_join(F.transform("l", lambda x: x["a"]), ""), F.get("l", F.lit(0))["a"])
    books = links.select(F.concat(F.lit(site), F.col("b").cast("string")).alias("url"), body.alias("html"))
    listing = books.select(F.concat(F.lit('<a href="'), "url", F.lit('">b</a><a href="/other">o</a>')).alias("html"))
    found = assemble_stories(listing, books.unionByName(chapters), "http://site.test", content=("article",), titles=("h1",))
    return found.select("url", "title", F.md5("content").alias("content_md5"), "n_parts")


SQL_CHAPTERS = SQL_PAGES[:SQL_PAGES.rindex("SELECT page_id, CASE")] + """, g AS (SELECT page_id // 5 AS b, count(*) FILTER (length(c) > 100) AS n_parts, string_agg(c, chr(10) || chr(10) ORDER BY page_id DESC) FILTER (length(c) > 100) AS content FROM x GROUP BY 1)
SELECT 'http://site.test/truyen.aspx?tid=' || b AS url, 'Book ' || b AS title, md5(content) AS content_md5, n_parts FROM g WHERE length(content) >= 500"""


ENTRIES = {
    "chapter_texts": (chapter_texts, SQL_CHAPTERS),
    "clean_article_text": (clean_article_text, SQL_CLEAN),
    "lead_paragraphs": (lead_paragraphs, SQL_LEAD),
    "clean_description": (clean_description, SQL_DESC),
    "book_cards": (book_cards, SQL_CARDS),
    "page_bands": (page_bands, SQL_BANDS),
    "body_excerpts": (body_excerpts, SQL_EXCERPTS),
    "display_snippets": (display_snippets, SQL_SNIPPET),
    "frequent_tokens": (frequent_tokens, SQL_TOKENS),
    "audit_titles": (audit_titles, SQL_AUDIT_TITLES),
    "content_years": (content_years, SQL_YEARS),
    "genre_names": (genre_names, SQL_GENRE),
    "mapped_genres": (mapped_genres, SQL_MAPPED),
    "infobox_fields": (infobox_fields, SQL_INFOBOX),
    "text_fallbacks": (text_fallbacks, SQL_FALLBACKS),
    "article_kinds": (article_kinds, SQL_KINDS),
    "answer_objects": (answer_objects, SQL_OBJECTS),
    "answer_lists": (answer_lists, SQL_LISTS),
    "labelled_answers": (labelled_answers, SQL_LABELLED),
    "canon_pairs": (canon_pairs, SQL_CANON),
    "expected_titles": (expected_titles, SQL_EXPECTED),
    "summary_cards": (summary_cards, SQL_SUMMARY_CARDS),
    "header_tags": (header_tags, SQL_HEADER_TAGS),
    "suggested_values": (suggested_values, SQL_SUGGESTED),
    "isbn_choice": (isbn_choice, SQL_ISBN),
    "name_ids": (name_ids, SQL_IDS),
    "file_names": (file_names, SQL_NAMES),
    "direct_urls": (direct_urls, SQL_URLS),
    "web_pages": (web_pages, SQL_PAGES),
}
