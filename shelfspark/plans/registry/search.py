"""Retrieval: lexical, vector, fused and reranked search and its evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import SearchConfig
from shelfspark.functions.text import words
from shelfspark.operators import evaluate, lsh, retrieve, vectors
from shelfspark.operators.bm25 import LexicalIndex, Queries, search
from shelfspark.plans.registry import sql as S
from shelfspark.plans.search import Library
from shelfspark.session import materialize, shared_dir
from shelfspark.sources.tables import load

K = 10


def _docs(spark, d) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text")


def _queries(spark, d) -> Queries:
    """Every benchmark passage is a query."""
    return Queries.of(load(spark, d, "benchmark", "item_id", "text"), "item_id", "text")


def _library(spark, d, store: bool = True) -> Library:
    return Library.build(_docs(spark, d), store=store)


# ------------------------------------------------------------------ SQL building blocks
_TERMS = f"""dt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY 1, 2),
 dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN dt USING (doc_id) GROUP BY 1),
 cs AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM dl),
 df AS MATERIALIZED (SELECT term, count(*) AS df FROM dt GROUP BY 1),
 raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM df, cs),
 idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_QT = f"""qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({S.tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""
_BM25 = f"""{_TERMS}, {_QT},
 sc AS (SELECT query_id, dt.doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN dt USING (term) JOIN dl USING (doc_id), cs GROUP BY 1, 2),
 bm AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM sc)"""


def _hashed(name: str, src: str, key: str) -> str:
    h = "md5(term)"
    return f"""{name}_s AS (SELECT {key}, CAST(('0x' || substr({h}, 1, 4)) AS INT) % 64 AS slot, sum(CASE WHEN substr({h}, 5, 1) < '8' THEN 1 ELSE -1 END * n) AS s FROM {src} GROUP BY 1, 2),
 {name}_n AS (SELECT {key}, sqrt(CAST(sum(s * s) AS DOUBLE)) AS nn FROM {name}_s GROUP BY 1),
 {name}_f AS (SELECT {key}, slot, CAST(CAST(s / nn AS FLOAT) AS DOUBLE) AS v FROM {name}_s JOIN {name}_n USING ({key}) WHERE nn > 0),
 {name} AS MATERIALIZED (SELECT {key}, slot, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_f)"""


_VEC = f"""{_hashed('dv', '(SELECT doc_id, term, tf AS n FROM dt)', 'doc_id')}, {_hashed('qv', '(SELECT query_id, term, qtf AS n FROM qt)', 'query_id')},
 vs AS (SELECT q.query_id, d.doc_id, round(coalesce(sum(qv.v * dv.v), 0), 6) + 0.0 AS score FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN (SELECT doc_id FROM documents) d
  LEFT JOIN qv ON qv.query_id = q.query_id LEFT JOIN dv ON dv.doc_id = d.doc_id AND dv.slot = qv.slot GROUP BY 1, 2),
 ve AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM vs)"""


def _fused(name: str, n: int) -> str:
    return f"""{name}_u AS (SELECT query_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank + 1)), 8) AS score, sum(b) AS bm25_score, max(br) AS bm25_rank, sum(v) AS vector_score, max(vr) AS vector_rank FROM (
   SELECT query_id, doc_id, rank, score AS b, rank AS br, 0.0::DOUBLE AS v, -1 AS vr FROM bm WHERE rank < {n}
   UNION ALL SELECT query_id, doc_id, rank, 0.0::DOUBLE, -1, score, rank FROM ve WHERE rank < {n}) GROUP BY 1, 2),
 {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM {name}_u)"""


def _overlap(q: str, t: str) -> str:
    qs = f"list_distinct({S.tokens(q)})"
    return f"round(len(list_intersect({qs}, list_distinct({S.tokens(f'substr({t}, 1, 192)')}))) / CAST(len({qs}) AS DOUBLE), 6)"


def _reranked(name: str, src: str, n: int) -> str:
    return f"""{name}_p AS (SELECT f.query_id, f.doc_id, {_overlap('b.text', 'd.text')} AS score, f.bm25_rank, f.vector_rank FROM {src} f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d USING (doc_id) WHERE f.rank < {n}),
 {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM {name}_p)"""


_HYBRID = f"WITH {_BM25}, {_VEC}, {_fused('hy', 3 * K)}"
_RERANK = f"{_HYBRID}, {_reranked('rr', 'hy', K)}"


# ------------------------------------------------------------------ index
def bm25_terms(spark, d):
    """Document frequency and idf of every term."""
    s = LexicalIndex.build(_docs(spark, d)).stored().term_stats()
    return s.select("term", "df", F.round("idf", 6).alias("idf"))


SQL_TERM = f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf"


def bm25_corpus(spark, d):
    c = LexicalIndex.build(_docs(spark, d)).corpus()
    return c.select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


SQL_CORPUS = f"WITH {_TERMS} SELECT n AS n_docs, CAST((SELECT sum(dl) FROM dl) AS BIGINT) AS n_tokens, round(avgdl, 6) AS avgdl FROM cs"


def bm25_topk(spark, d):
    """The flagship: every passage against every document, ten best each."""
    return search(LexicalIndex.build(_docs(spark, d)).stored(), _queries(spark, d), K)


def bm25_single(spark, d):
    """One query against a saved index, read by term: the first passage."""
    path = f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    LexicalIndex.build(_docs(spark, d)).save(path)
    one = load(spark, d, "benchmark", "item_id", "text").orderBy("item_id").limit(1)
    return search(LexicalIndex.load(spark, path), Queries.of(one, "item_id", "text"), K)


SQL_SINGLE = f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank < {K} AND query_id = (SELECT min(item_id) FROM benchmark)"
SQL_BM25 = f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank < {K}"


# ------------------------------------------------------------------ vectors
def knn_centroids(spark, d):
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label")
    c = vectors.centroids(e, "label", "embedding").withColumnRenamed("label", "query_id")
    return vectors.with_distance(vectors.nearest(e, c, K, vec_id="vec_id")).withColumn("query_id", F.col("query_id").cast("long"))


SQL_KNN = f"""
WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
 c AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY 1), xn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
 s AS (SELECT c.label, x.vec_id, round(sum(c.v * x.v) / (any_value(cn.n) * any_value(xn.n)), 6) AS score FROM c JOIN x USING (i) JOIN cn ON cn.label = c.label JOIN xn ON xn.vec_id = x.vec_id GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1 AS rank FROM s)
SELECT CAST(label AS BIGINT) AS query_id, vec_id, score, rank, round(1 - score, 6) AS distance FROM r WHERE rank < {K}"""


_APPROX = {"tables": 4, "bits": 5, "seed": 1}


def vector_approx(spark, d):
    """Approximate neighbours of the centroids: four tables of five planes, two bits probed."""
    e = load(spark, d, "embeddings", "vec_id", "embedding", "label")
    index = lsh.LshIndex.build(e, "vec_id", "embedding", **_APPROX)
    c = vectors.centroids(e, "label", "embedding").withColumnRenamed("label", "query_id")
    return lsh.nearest(index, c, K, probe_bits=2).withColumn("query_id", F.col("query_id").cast("long"))


SQL_APPROX = f"""
WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
 c AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY 1), xn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
 pl AS (SELECT t, b, i, CASE WHEN substr(md5('1:' || t || ':' || b || ':' || i), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
  FROM (SELECT unnest(range(4)) AS t), (SELECT unnest(range(5)) AS b), (SELECT unnest(range((SELECT max(i) + 1 FROM x))) AS i)),
 xs AS (SELECT x.vec_id, t, b, round(sum(v * s) / any_value(n), 6) AS z FROM x JOIN pl USING (i) JOIN xn USING (vec_id) GROUP BY 1, 2, 3),
 cs AS (SELECT label, t, b, round(sum(v * s) / any_value(n), 6) AS z FROM c JOIN pl USING (i) JOIN cn USING (label) GROUP BY 1, 2, 3),
 cr AS (SELECT *, row_number() OVER (PARTITION BY label, t ORDER BY abs(z), b) > 2 AS sure FROM cs),
 hit AS (SELECT DISTINCT label, vec_id FROM (SELECT cr.label, xs.vec_id, cr.t FROM cr JOIN xs USING (t, b) GROUP BY 1, 2, 3 HAVING bool_and((cr.z >= 0) = (xs.z >= 0) OR NOT sure))),
 s AS (SELECT h.label, h.vec_id, round(sum(c.v * x.v) / (any_value(cn.n) * any_value(xn.n)), 6) AS score FROM hit h JOIN c ON c.label = h.label JOIN x ON x.vec_id = h.vec_id AND x.i = c.i
  JOIN cn ON cn.label = h.label JOIN xn ON xn.vec_id = h.vec_id GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS query_id, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1 AS rank FROM s QUALIFY rank < {K}"""


def vector_topk(spark, d):
    return _library(spark, d, store=False).vector(_queries(spark, d), K)


SQL_VECTOR = f"WITH {_TERMS}, {_QT}, {_VEC} SELECT query_id, doc_id, score, rank FROM ve WHERE rank < {K}"


# ------------------------------------------------------------------ fusion and reranking
def hybrid_topk(spark, d):
    return _library(spark, d).hybrid(_queries(spark, d), K)


SQL_HYBRID = f"{_HYBRID} SELECT query_id, doc_id, score, bm25_score, bm25_rank, vector_score, vector_rank, rank FROM hy WHERE rank < {K}"


def reranked_topk(spark, d):
    return _library(spark, d).reranked(_queries(spark, d), K).select("query_id", "doc_id", "score", "bm25_rank", "vector_rank", "rank")


SQL_RERANKED = f"{_RERANK} SELECT query_id, doc_id, score, bm25_rank, vector_rank, rank FROM rr"


def reranked_above(spark, d):
    r = _library(spark, d).reranked(_queries(spark, d), K)
    return retrieve.above_threshold(r, 0.3).select("query_id", "doc_id", "score")


SQL_ABOVE = f"{_RERANK} SELECT query_id, doc_id, score FROM rr WHERE score >= 0.3"


def mode_comparison(spark, d):
    return _library(spark, d).compare(_queries(spark, d), K)


def _modes(cols: str) -> str:
    return (f"SELECT 'bm25' AS mode, {cols} FROM bm WHERE rank < {K} UNION ALL SELECT 'vector', {cols} FROM ve WHERE rank < {K} "
            f"UNION ALL SELECT 'hybrid', {cols} FROM hy WHERE rank < {K} UNION ALL SELECT 'hybrid_rerank', {cols} FROM rr")


SQL_MODES = f"{_RERANK} {_modes('query_id, doc_id, score, rank')}"


def merged_pool(spark, d):
    lib, q = _library(spark, d), _queries(spark, d)
    m = retrieve.merge_pool(lib.lexical(q, 100), lib.vector(q, 100), q, lib.docs)
    return m.select("query_id", "doc_id", "score", "rank")


SQL_POOL = f"""WITH {_BM25}, {_VEC},
 mp AS (SELECT query_id, doc_id, arg_max(score, g) AS score FROM (SELECT query_id, doc_id, score, 0 AS g FROM bm WHERE rank < 100 UNION ALL SELECT query_id, doc_id, score, 1 FROM ve WHERE rank < 100) GROUP BY 1, 2),
 mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS r FROM mp),
 ms AS (SELECT m.query_id, m.doc_id, r, CASE WHEN r < 60 THEN {_overlap('b.text', 'd.text')} ELSE score END AS score FROM mr m JOIN benchmark b ON b.item_id = m.query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r >= 60, CASE WHEN r < 60 THEN 0 ELSE r END, score DESC, doc_id) - 1 AS rank FROM ms
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r >= 60, CASE WHEN r < 60 THEN 0 ELSE r END, score DESC, doc_id) <= 1000"""

_GATES = SearchConfig(block_below=0.2, warn_below=0.5)


def gated_contexts(spark, d):
    q = _queries(spark, d)
    return retrieve.gate(_library(spark, d).reranked(q, K), q, 5, _GATES)


SQL_GATED = f"""{_RERANK}, st AS (SELECT b.item_id AS query_id, CASE WHEN r.score IS NULL THEN 'empty' WHEN r.score < 0.2 THEN 'blocked' WHEN r.score < 0.5 THEN 'low_confidence' ELSE 'ok' END AS status
  FROM benchmark b LEFT JOIN rr r ON r.query_id = b.item_id AND r.rank = 0)
SELECT st.query_id, status, r.rank + 1 AS source_idx, r.doc_id, r.score FROM st LEFT JOIN rr r ON r.query_id = st.query_id AND r.rank < 5 AND status IN ('ok', 'low_confidence')"""


def retrieved_contexts(spark, d):
    """Lexical results gated and numbered; every second query merges them with an earlier pool."""
    q = _queries(spark, d)
    found = materialize(_library(spark, d).lexical(q, 8), "found")
    pool = found.filter((F.col("rank") >= 3) & (F.col("query_id") % 2 == 0)).select("query_id", "doc_id", (F.col("score") * 2).alias("score"))
    contexts, _ = retrieve.retrieve(found.filter("rank < 5"), q, 4, pool, scorer=None, cfg=SearchConfig(block_below=25.0, warn_below=40.0))
    return contexts


SQL_RETRIEVED = f"""WITH {_BM25}, new AS (SELECT * FROM bm WHERE rank < 5), pool AS (SELECT query_id, doc_id, score * 2 AS score FROM bm WHERE rank BETWEEN 3 AND 7 AND query_id % 2 = 0),
 pq AS (SELECT DISTINCT query_id FROM pool), shut AS (SELECT query_id FROM new WHERE rank = 0 AND score < 25 AND query_id NOT IN (SELECT query_id FROM pq)),
 u AS (SELECT query_id, doc_id, score FROM new WHERE query_id IN (SELECT query_id FROM pq) UNION ALL SELECT p.* FROM pool p WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.query_id = p.query_id AND n.doc_id = p.doc_id)),
 m AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM u
  UNION ALL SELECT query_id, doc_id, score, rank FROM new WHERE query_id NOT IN (SELECT query_id FROM pq) AND query_id NOT IN (SELECT query_id FROM shut)),
 st AS (SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM shut) THEN 'blocked' WHEN m.score IS NULL THEN 'empty' WHEN m.score < 40 THEN 'low_confidence' ELSE 'ok' END AS status
  FROM benchmark LEFT JOIN m ON m.query_id = item_id AND m.rank = 0)
SELECT st.query_id, status, m.rank + 1 AS source_idx, doc_id, score FROM st LEFT JOIN m ON m.query_id = st.query_id AND m.rank < 4"""


def score_bars(spark, d):
    return retrieve.display_percent(_library(spark, d).lexical(_queries(spark, d), K)).select("query_id", "doc_id", "bar_pct")


SQL_BARS = f"""WITH {_BM25} SELECT query_id, doc_id, CAST(floor(CASE WHEN max(score) OVER w = min(score) OVER w THEN 100 ELSE 12 + 88 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END) AS BIGINT) AS bar_pct
 FROM (SELECT * FROM bm WHERE rank < {K}) WINDOW w AS (PARTITION BY query_id)"""


# ------------------------------------------------------------------ evaluation
def _tests(spark, d) -> DataFrame:
    """Each passage with its two longest words and a source name as expected keywords."""
    b = load(spark, d, "benchmark", "item_id", "text")
    longest = F.array_sort(F.array_distinct(F.transform(words(F.lower("text")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))))
    kind = F.element_at(F.array(F.lit("FACTUAL"), F.lit("AUTHOR"), F.lit("SEMANTIC")), (F.length("text") % 3 + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), kind.alias("query_type"),
                    F.concat(F.slice(F.transform(longest, lambda s: s["w"]), 1, 2), F.array(F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string")))).alias("keywords"))


def _told(spark, d) -> Library:
    """The documents with their source, which counts for relevance as well."""
    return Library.build(load(spark, d, "documents", "doc_id", "text", "source"))


_EVAL = f"""{_RERANK}, ts AS (SELECT item_id AS query_id, ['FACTUAL', 'AUTHOR', 'SEMANTIC'][length(text) % 3 + 1] AS query_type,
  [x.w FOR x IN list_slice(list_sort(list_distinct([struct_pack(n := -length(w), w := w) FOR w IN {S.words('lower(text)')}])), 1, 2)] || ['src' || item_id % 20] AS kw FROM benchmark),
 res AS ({_modes('query_id, doc_id, rank')}),
 fl AS (SELECT mode, r.query_id, rank, len([k FOR k IN kw IF contains(lower(d.text || ' ' || d.source), k)]) > 0 AS rel FROM res r JOIN ts USING (query_id) JOIN documents d USING (doc_id)),
 qm AS (SELECT m.mode, ts.query_id, query_type, k.k, count(*) FILTER (rel AND rank < k.k) AS hits, count(rank) FILTER (rank < k.k) AS got, min(rank) FILTER (rel) AS fh
  FROM ts CROSS JOIN (SELECT unnest(['bm25', 'vector', 'hybrid', 'hybrid_rerank']) AS mode) m CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) k
  LEFT JOIN fl ON fl.query_id = ts.query_id AND fl.mode = m.mode GROUP BY 1, 2, 3, 4),
 mt AS (SELECT mode, query_id, query_type, CAST(k AS BIGINT) AS k, hits / CAST(k AS DOUBLE) AS precision, CASE WHEN fh IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (fh + 1) END AS mrr, got, hits FROM qm)"""


def eval_per_query(spark, d):
    m = _told(spark, d).evaluate(_tests(spark, d))
    return m.select("mode", "query_id", "query_type", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall_simplified", "f1", "mrr")], "n_retrieved", "n_relevant")


SQL_EVAL_Q = f"{_EVAL} SELECT mode, query_id, query_type, k, round(precision, 6) AS precision, round(precision, 6) AS recall_simplified, round(precision, 6) AS f1, round(mrr, 6) AS mrr, got AS n_retrieved, hits AS n_relevant FROM mt"


def eval_averages(spark, d):
    return evaluate.macro_average(_told(spark, d).evaluate(_tests(spark, d)))


_AVG = "count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(precision), 6) AS recall_simplified, round(avg(precision), 6) AS f1, round(avg(mrr), 6) AS mrr"
SQL_EVAL = f"{_EVAL} SELECT mode, k, query_type, {_AVG} FROM mt GROUP BY 1, 2, 3 UNION ALL SELECT mode, k, 'ALL', {_AVG} FROM mt GROUP BY 1, 2"

ENTRIES = {
    "bm25_terms": (bm25_terms, SQL_TERM),
    "bm25_corpus": (bm25_corpus, SQL_CORPUS),
    "retrieved_contexts": (retrieved_contexts, SQL_RETRIEVED),
    "bm25_single": (bm25_single, SQL_SINGLE),
    "bm25_topk": (bm25_topk, SQL_BM25),
    "knn_centroids": (knn_centroids, SQL_KNN),
    "vector_approx": (vector_approx, SQL_APPROX),
    "vector_topk": (vector_topk, SQL_VECTOR),
    "hybrid_topk": (hybrid_topk, SQL_HYBRID),
    "reranked_topk": (reranked_topk, SQL_RERANKED),
    "reranked_above": (reranked_above, SQL_ABOVE),
    "mode_comparison": (mode_comparison, SQL_MODES),
    "merged_pool": (merged_pool, SQL_POOL),
    "gated_contexts": (gated_contexts, SQL_GATED),
    "score_bars": (score_bars, SQL_BARS),
    "eval_per_query": (eval_per_query, SQL_EVAL_Q),
    "eval_averages": (eval_averages, SQL_EVAL),
}
