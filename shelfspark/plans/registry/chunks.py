"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators.chunk import chunk, strategy_stats
from shelfspark.plans.registry import sql as S
from shelfspark.sources.tables import load


def _chunks(strategy: str):
    def run(spark, d):
        c = chunk(load(spark, d, "documents", "doc_id", "text"), strategy)
        return c.select("chunk_id", "doc_id", "start_word", "end_word", "word_count", "char_count", F.md5("text").alias("text_md5"))
    return run


def _even_sql(step: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 200, 0) / {step}.0) AS BIGINT) + 1)) AS i FROM w WHERE len(w) >= 30),
 p AS (SELECT doc_id, w, i, i * {step} AS a, least(i * {step} + 200, len(w)) AS b FROM s)
SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id, a AS start_word, b AS end_word, b - a AS word_count,
 length(array_to_string(w[a + 1:b], ' ')) AS char_count, md5(array_to_string(w[a + 1:b], ' ')) AS text_md5
FROM p WHERE b - a >= 30"""


# The running fold over the sentences is a recursive query: one step per sentence.
_SENTENCES = f"""
t AS (SELECT doc_id, {S.squeeze('text')} AS t FROM documents),
m AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?…]) ', '\\1' || chr(1), 'g'), chr(1)) AS byq FROM t),
l AS (SELECT doc_id, t, [len(regexp_extract_all(s, '[^ ]+')) FOR s IN
   (CASE WHEN len(byq) <= 1 THEN regexp_split_to_array(t, '[,;\\n]+') ELSE byq END) IF len(regexp_extract_all(s, '[^ ]+')) > 0] AS k FROM m
   WHERE len(regexp_extract_all(t, '[^ ]+')) >= 30),
f AS (
  SELECT doc_id, k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM l
  UNION ALL
  SELECT doc_id, k, j + 1,
   CASE WHEN run + k[j+1] > 200 AND run >= 30 THEN k[j+1] ELSE run + k[j+1] END,
   CASE WHEN run + k[j+1] > 200 AND run >= 30 THEN greatest(0, pos - k[j+1]) ELSE st END, pos + k[j+1],
   CASE WHEN run + k[j+1] > 200 AND run >= 30 THEN n + 1 ELSE n END,
   CASE WHEN run + k[j+1] > 200 AND run >= 30 THEN st END, CASE WHEN run + k[j+1] > 200 AND run >= 30 THEN pos END
  FROM f WHERE j < len(k)),
sp AS (SELECT doc_id, n - 1 AS i, a, b FROM f WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, n, st, pos FROM f WHERE j = len(k) AND pos > st)"""

SQL_SENTENCE = f"""
WITH RECURSIVE {_SENTENCES},
p AS (SELECT sp.*, string_split(t.t, ' ') AS w FROM sp JOIN t USING (doc_id))
SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id, a AS start_word, b AS end_word, b - a AS word_count,
 length(array_to_string(w[a + 1:b], ' ')) AS char_count, md5(array_to_string(w[a + 1:b], ' ')) AS text_md5
FROM p WHERE b - a >= 30"""


def chunk_strategy_stats(spark, d):
    return strategy_stats(load(spark, d, "documents", "doc_id", "text"))


def _spans_of(step: int) -> str:
    return (f"SELECT doc_id, least(i * {step} + 200, n) - i * {step} AS wc FROM (SELECT doc_id, n, unnest(range(0, "
            f"CAST(ceil(greatest(n - 200, 0) / {step}.0) AS BIGINT) + 1)) AS i FROM nw WHERE n >= 30)")


SQL_STATS = f"""
WITH RECURSIVE {_SENTENCES},
nw AS (SELECT doc_id, {S.word_count('text')} AS n FROM documents),
a AS (SELECT 'fixed_size' AS strategy, * FROM ({_spans_of(150)}) UNION ALL SELECT 'sliding_window', * FROM ({_spans_of(100)})
 UNION ALL SELECT 'sentence_aware', doc_id, b - a FROM sp),
pd AS (SELECT strategy, doc_id, count(*) AS n, sum(wc) AS words, round(sum(wc) / count(*), 1) AS avg_words, min(wc) AS lo, max(wc) AS hi,
  round(sum(wc) / greatest(any_value(nw.n), 1), 2) AS cov FROM a JOIN nw USING (doc_id) WHERE wc >= 30 GROUP BY 1, 2)
SELECT strategy, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(words) AS BIGINT) AS total_words, round(avg(avg_words), 1) AS avg_words, min(avg_words) AS min_avg,
 max(avg_words) AS max_avg, min(lo) AS min_words, max(hi) AS max_words, round(avg(cov), 2) AS coverage FROM pd GROUP BY 1"""

ENTRIES = {
    "chunk_fixed": (_chunks("fixed_size"), _even_sql(150)),
    "chunk_sliding": (_chunks("sliding_window"), _even_sql(100)),
    "chunk_sentence": (_chunks("sentence_aware"), SQL_SENTENCE),
    "chunk_strategy_stats": (chunk_strategy_stats, SQL_STATS),
}
