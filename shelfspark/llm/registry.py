"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import table


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.decontamination import find_contamination
    return find_contamination(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from shelfspark.llm.token_counts import count_tokens
    return count_tokens(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.substring_dedup import remove_repeats
    return remove_repeats(table(spark, folder, "documents", "doc_id", "text")).drop("kept")


def op4_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a stored replica of all pages against their source, after a drill: in the stored
    one the bodies of some urls are altered and some records are left out (chosen by url digest)."""
    from shelfspark.llm.common import materialize
    from shelfspark.llm.warc import archive, audit
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    mark = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 2)
    body = F.coalesce("html", F.lit(""))
    harmed = F.when(mark == "00", F.concat(F.lit("#"), F.expr("substring(coalesce(html, ''), 2)"))).otherwise(body)
    stored = materialize(archive(pages.filter(mark != "01").withColumn("html", harmed)), "replica")
    return audit(archive(pages), stored).withColumnRenamed("key", "page_id")


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || md5(u) || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen({b}) AS VARCHAR)
 || chr(13) || chr(10) || chr(13) || chr(10) || {b} || chr(13) || chr(10) || chr(13) || chr(10)"""
OP4_SQL = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS b, CASE WHEN md5(coalesce(url, '')) LIKE '00%' THEN '#' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS h FROM pages),
 r AS (SELECT page_id, CAST(floor(page_id / 16.0) AS BIGINT) AS leaf, md5(u) AS m, sha256({_RECORD.format(b='b')}) AS e, sha256({_RECORD.format(b='h')}) AS f, strlen({_RECORD.format(b='b')}) AS n FROM p),
 l AS (SELECT leaf, CAST(sum(n) AS BIGINT) AS range_bytes FROM r GROUP BY 1),
 o AS (SELECT leaf, range_bytes, CAST(sum(range_bytes) OVER (ORDER BY leaf) - range_bytes AS BIGINT) AS range_offset FROM l)
SELECT page_id, CASE WHEN m LIKE '01%' THEN 'missing' ELSE 'changed' END AS status, leaf, range_offset, range_bytes, e AS expected_sha256,
 CASE WHEN m LIKE '01%' THEN NULL ELSE f END AS found_sha256, CAST(1 AS BIGINT) AS n_expected, CAST(CASE WHEN m LIKE '01%' THEN 0 ELSE 1 END AS BIGINT) AS n_found
FROM r JOIN o USING (leaf) WHERE (m LIKE '00%' AND e <> f) OR m LIKE '01%'"""


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.jaccard_join import jaccard_join
    return jaccard_join(table(spark, folder, "documents", "doc_id", "text")).drop("text_hash")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from shelfspark.llm.bpe import encode_decode
    return encode_decode(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.quality import fit, score_documents
    docs = table(spark, folder, "documents", "doc_id", "text")
    return score_documents(docs, fit(docs, table(spark, folder, "labels", "doc_id", "quality")))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.pii import digest_pii, find_pii
    return digest_pii(find_pii(table(spark, folder, "documents", "doc_id", "text")))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.toxicity import fit, score_documents
    docs = table(spark, folder, "documents", "doc_id", "text")
    return score_documents(docs, fit(docs, table(spark, folder, "labels", "doc_id", "toxic")))


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.ann import search
    return search(table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.prefix_trie import rebuilt_trie
    return rebuilt_trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.filter_audit import audit
    return audit(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "labels", "doc_id", "quality", "toxic"))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.mixing import plan_mix
    planned = plan_mix(table(spark, folder, "documents", "doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
#: crc32 of a decimal number: one byte after the other through eight steps of the polynomial.
_STEP = "(CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END)"
OP11_SQL = f"""WITH RECURSIVE bits(b, k, v) AS (SELECT b, 0, b FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b) UNION ALL SELECT b, k + 1, {_STEP.format('v')} FROM bits WHERE k < 8),
 tab AS (SELECT list(v ORDER BY b) AS l FROM bits WHERE k = 8),
 t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r,
   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len({_WORDS.format('text')}) AS w FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, list(struct_pack(id := id, w := w) ORDER BY r) AS own FROM t GROUP BY 1),
 h AS (SELECT conv_id, own, xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')], LAMBDA a, x: xor(a // 256, l[xor(a, x) % 256 + 1])), 4294967295) % 4 AS h FROM c, tab),
 s AS (SELECT h.conv_id, coalesce(list_slice(b.own, 1, h.h), []) || coalesce(list_slice(h.own, h.h + 1, len(h.own)), []) AS seq FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
 p AS (SELECT conv_id, len(seq) AS n, d, md5(coalesce(array_to_string([x.id FOR x IN list_slice(seq, 1, d)], ','), '')) AS k, CASE WHEN d = 0 THEN 0 ELSE seq[d].w END AS w FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
 nd AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM p GROUP BY 1, 2),
 up AS (SELECT v.d, v.k, v.n, v.w, a.d AS ad, a.k AS ak FROM nd v JOIN p a ON a.conv_id = v.conv_id AND a.d <= v.d),
 ch AS (SELECT ad AS d, ak AS k, count(*) AS n FROM up WHERE d = ad + 1 GROUP BY 1, 2),
 lf AS (SELECT up.ad AS d, up.ak AS k, count(*) FILTER (ch.n IS NULL) AS leaves, sum((up.n - 1) * w) AS saved FROM up LEFT JOIN ch ON ch.d = up.d AND ch.k = up.k GROUP BY 1, 2),
 pa AS (SELECT up.d, up.k, nd.conv_id FROM up JOIN nd ON nd.d = ad AND nd.k = ak WHERE ad = up.d - 1)
SELECT nd.conv_id, CAST(nd.d AS BIGINT) AS depth, pa.conv_id AS parent_conv_id, nd.n AS n_convs, coalesce(ch.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM nd LEFT JOIN ch USING (d, k) LEFT JOIN lf USING (d, k) LEFT JOIN pa USING (d, k)"""

OP12_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
 f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], LAMBDA x: CASE x WHEN 'A' THEN len(w) < 50 WHEN 'B' THEN 100 * len(list_distinct(w)) < 65 * len(w)
   WHEN 'C' THEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(doc_id > first, FALSE) END) AS fails
   FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
 o(fo) AS (SELECT '' UNION ALL SELECT fo || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(fo, x) AND length(fo) < 5),
 st AS (SELECT fo AS filter_order, s AS step, substr(fo, s, 1) AS x, string_split(substr(fo, 1, s), '') AS upto, CASE WHEN s = 1 THEN [] ELSE string_split(substr(fo, 1, s - 1), '') END AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS s) WHERE length(fo) = 5),
 r AS (SELECT part, filter_order, step, x, CAST(sum(n) FILTER (NOT list_has_any(fails, upto)) AS BIGINT) AS kept,
   CAST(sum(n) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)) AS BIGINT) AS removed, CAST(sum(n) FILTER (list_contains(fails, x) AND list_has_any(fails, before)) AS BIGINT) AS redundant,
   CAST(sum(n) FILTER (fails = [x]) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)) AS BIGINT) AS good_lost,
   CAST(sum(toxic) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)) AS BIGINT) AS toxic_lost FROM g, st GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost,
 coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""

_BITS60 = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"
OP13_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS ss FROM d GROUP BY 1),
 w AS (SELECT source, ss, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w, 3 * ss AS most FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY most * 6 // w, source NULLS LAST) AS o FROM w),
 c AS (SELECT *, CAST((SELECT sum(ss) FROM w) AS HUGEINT) - CAST(coalesce(sum(most) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS num, CAST(sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS den FROM o),
 lv AS (SELECT num AS ln, den AS ld FROM c WHERE num * w <= most * den ORDER BY o LIMIT 1),
 t AS (SELECT source, ss, CASE WHEN ln * w > most * ld THEN most ELSE ln * w END AS num, CASE WHEN ln * w > most * ld THEN 1 ELSE ld END AS den FROM w LEFT JOIN lv ON TRUE),
 r AS (SELECT source, ss, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target, CASE WHEN ss > 0 THEN CAST(num * 16777216 // (den * ss) AS BIGINT) ELSE 0 END AS rate,
   {_BITS60.format("'0:' || coalesce('=' || source, '')")} % 16777216 AS off FROM t),
 p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, {_BITS60.format("concat_ws(':', '0', CAST(doc_id AS VARCHAR))")}, doc_id NULLS FIRST) AS k FROM d)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target, ((k * rate + off) // 16777216 - ((k - 1) * rate + off) // 16777216) * size AS taken FROM p JOIN r ON r.source IS NOT DISTINCT FROM p.source"""


#: name -> (query, SQL for DuckDB or None where SQL cannot express it)
ENTRIES = {
    "op1_decontamination": (op1_decontamination, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_substring_dedup": (op3_substring_dedup, None),
    "op4_fixity_audit": (op4_fixity_audit, OP4_SQL),
    "op5_jaccard_join": (op5_jaccard_join, None),
    "op6_bpe": (op6_bpe, None),
    "op7_quality": (op7_quality, None),
    "op8_pii": (op8_pii, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_nearest": (op10_nearest, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_mixing": (op13_mixing, OP13_SQL),
}


def entries() -> dict:
    return dict(ENTRIES)
