"""Conversations: memory, prompts, suggestions, answer checks and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import MemoryConfig
from shelfspark.functions.text import estimate_tokens
from shelfspark.operators import evaluate, memory, retrieve
from shelfspark.plans.registry import sql as S
from shelfspark.plans.registry.search import _BM25, _docs, _library, _queries
from shelfspark.session import shared_dir
from shelfspark.sources import files
from shelfspark.sources.tables import load
from shelfspark.streaming import incremental


def _messages(spark, d):
    return load(spark, d, "conversations", "conv_id", "turn", "role", "text")


def last_turns(spark, d):
    return memory.last_turns(_messages(spark, d), 2).select("conv_id", "turn", "back")


SQL_LAST = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS back FROM conversations QUALIFY back < 4"


def chat_history(spark, d):
    return memory.format_history(_messages(spark, d), MemoryConfig(window=5))


def _line(x: str = "text") -> str:
    body = f"replace({S.strip(x)}, chr(10), ' ')"
    return (f"CASE WHEN {body} <> '' THEN CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || "
            f"CASE WHEN length({body}) > 5000 THEN substr({body}, 1, 5000) || '…' ELSE {body} END END")


SQL_HISTORY = f"""
WITH l AS (SELECT conv_id, turn, {_line()} AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM l WHERE line IS NOT NULL GROUP BY 1"""


def memory_fit(spark, d):
    return memory.fit_memory(_messages(spark, d), budget=256)


SQL_FIT = f"""
WITH m AS (SELECT conv_id, turn, {_line()} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 p AS (SELECT * FROM m WHERE i < n - 1),
 s AS (SELECT *, coalesce(sum(length(line)) OVER w, 0) + greatest(count(line) OVER w - 1, 0) AS chars, n - 1 - i AS kept FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
 t AS (SELECT *, CASE WHEN chars = 0 THEN 0 ELSE chars // 3 + 1 END AS tok FROM s),
 c AS (SELECT conv_id, min(i) AS st, arg_min(tok, i) AS tok FROM t WHERE i % 2 = 0 AND (tok <= 256 OR kept <= 2) GROUP BY 1),
 n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, n AS n_messages, CASE WHEN n <= 1 THEN 0 ELSE coalesce(st, n - 1) END AS summarized_idx, CASE WHEN n <= 1 THEN 0 ELSE n - 1 - coalesce(st, n - 1) END AS kept,
 CAST(coalesce(tok, 0) AS BIGINT) AS history_tokens FROM n LEFT JOIN c USING (conv_id)"""


def memory_resume(spark, d):
    """The same, going on from an earlier cut and its summary."""
    m = _messages(spark, d)
    state = m.select("conv_id").distinct().withColumns({"summarized_idx": F.col("conv_id") % 4, "summary": F.repeat(F.lit("tóm tắt "), (F.col("conv_id") % 30).cast("int"))})
    return memory.fit_memory(m, budget=256, state=state)


SQL_RESUME = f"""
WITH m AS (SELECT conv_id, turn, {_line()} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 p AS (SELECT *, least(conv_id % 4, n - 1) AS b, CASE WHEN conv_id % 30 = 0 THEN 0 ELSE (conv_id % 30 * 8) // 3 + 17 END AS x FROM m WHERE i < n - 1),
 s AS (SELECT *, coalesce(sum(length(line)) OVER w, 0) + greatest(count(line) OVER w - 1, 0) AS chars, n - 1 - i AS kept FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
 t AS (SELECT *, CASE WHEN chars = 0 THEN 0 ELSE chars // 3 + 1 END + x AS tok FROM s),
 c AS (SELECT conv_id, min(i) AS st, arg_min(tok, i) AS tok FROM t WHERE i >= b AND (i - b) % 2 = 0 AND (tok <= 256 OR kept <= 2) GROUP BY 1),
 n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, n AS n_messages, CASE WHEN n <= 1 THEN 0 ELSE coalesce(st, n - 1) END AS summarized_idx, CASE WHEN n <= 1 THEN 0 ELSE n - 1 - coalesce(st, n - 1) END AS kept,
 CAST(coalesce(tok, 0) AS BIGINT) AS history_tokens FROM n LEFT JOIN c USING (conv_id)"""


def token_totals(spark, d):
    return _messages(spark, d).groupBy("role").agg(F.sum(estimate_tokens("text")).alias("tokens"), F.count(F.lit(1)).alias("n"))


SQL_TOKENS = "SELECT role, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 3 + 1 END) AS BIGINT) AS tokens, count(*) AS n FROM conversations GROUP BY 1"


def _contexts(spark, d):
    q = _queries(spark, d)
    found = _library(spark, d).lexical(q, 3)
    texted = retrieve.attach_text(found, _docs(spark, d), q, 3)
    return q, texted.select("query_id", (F.col("rank") + 1).alias("source_idx"), "text", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
                            F.lit(None).cast("string").alias("author"), (F.col("score") < 30).alias("low_confidence"))


def prompts(spark, d):
    """Prompts with contexts, a summary for some and the history of the conversation of the same number."""
    q, c = _contexts(spark, d)
    past = memory.format_history(_messages(spark, d), MemoryConfig(window=2)).select(F.col("conv_id").alias("query_id"), "history")
    told = q.df.select("query_id").join(past, "query_id", "left").withColumn("summary", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("S"), F.col("query_id").cast("string"))))
    p = memory.build_prompts(c, q.df, "SYSTEM", "\n[low]\n", "[memory]\n", told.filter(F.col("query_id") % 4 != 1))
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"), "prompt_tokens")


SQL_PROMPTS = f"""WITH {_BM25}, l AS (SELECT conv_id, turn, {_line()} AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4),
 h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM l WHERE line IS NOT NULL GROUP BY 1),
 past AS (SELECT item_id AS pid, concat_ws(chr(10), CASE WHEN item_id % 3 = 0 THEN 'Tóm tắt các lượt trước đó: S' || item_id END, nullif(history, '')) AS told FROM benchmark LEFT JOIN h ON conv_id = item_id WHERE item_id % 4 <> 1), c AS (SELECT query_id, string_agg(chr(10) || '--- Nguồn [' || (rank + 1) || '] ---' || chr(10) || 'Tài liệu: Doc ' || doc_id || ' | Tác giả: Không rõ' || chr(10) || substr(text, 1, 800) || chr(10), '' ORDER BY rank) AS b,
  bool_or(score < 30) AS low FROM bm JOIN documents USING (doc_id) WHERE rank < 3 GROUP BY 1),
 p AS (SELECT item_id AS query_id, 'SYSTEM' || chr(10) || chr(10) || CASE WHEN coalesce(told, '') <> '' THEN '[memory]' || chr(10) || told || chr(10) || chr(10) ELSE '' END || '=== [NGỮ CẢNH] — CÁC ĐOẠN VĂN BẢN LIÊN QUAN ===' || CASE WHEN low THEN chr(10) || '[low]' || chr(10) ELSE '' END || chr(10) || coalesce(b, '')
   || chr(10) || '=== CÂU HỎI ===' || chr(10) || text || chr(10) || chr(10) || '=== CÂU TRẢ LỜI ===' AS p FROM benchmark LEFT JOIN c ON c.query_id = item_id LEFT JOIN past ON pid = item_id)
SELECT query_id, md5(p) AS prompt_md5, length(p) // 3 + 1 AS prompt_tokens FROM p"""


def fallback_questions(spark, d):
    q, c = _contexts(spark, d)
    top = q.df.join(c.filter(F.col("source_idx") == 1).select("query_id", "title", "author"), "query_id", "left")
    s = memory.fallback_questions(F.col("title"), F.col("author"), F.col("title").isNotNull(), 3)
    return top.select("query_id", F.array_join(s, " / ").alias("questions"))


SQL_FALLBACK = f"""WITH {_BM25} SELECT item_id AS query_id, CASE WHEN doc_id IS NULL THEN 'Các tác phẩm văn học Việt Nam nổi tiếng nhất là gì? / Những tác giả văn học Việt Nam tiêu biểu? / Văn học Việt Nam giai đoạn 1930–1945 có những đặc điểm gì?'
 ELSE 'Tóm tắt nội dung của ''Doc ' || doc_id || '''? / Tác giả tác giả này còn viết những tác phẩm nào khác? / Những tác phẩm tương tự ''Doc ' || doc_id || ''' là gì?' END AS questions
FROM benchmark LEFT JOIN bm ON bm.query_id = item_id AND rank = 0"""


def chat_export(spark, d):
    return memory.export_messages(_messages(spark, d)).select("conv_id", "turn", F.md5("json").alias("json_md5"), F.md5("txt").alias("txt_md5"))


SQL_EXPORT = """
SELECT conv_id, turn, md5(CAST(to_json({'role': role, 'content': text}) AS VARCHAR)) AS json_md5,
 md5(CASE WHEN role = 'user' THEN '👤 Người dùng' ELSE '🤖 Chatbot' END || ':' || chr(10) || text || chr(10) || repeat('-', 50)) AS txt_md5 FROM conversations"""

_CITE, _NONE = ("the", "la", "und"), ("que", "nicht")


def answer_checks(spark, d):
    m = _messages(spark, d).select(F.col("role").alias("case_type"), F.col("text").alias("answer"),
                                   F.when(F.col("turn") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ER"), F.lit("zz"))).alias("expect_keywords"),
                                   (F.col("turn") % 5 == 0).alias("expect_fallback"), F.col("turn").alias("latency"))
    return evaluate.answer_summary(evaluate.check_answers(m, citations=_CITE, fallbacks=_NONE), latency="latency")


_A = "count(*) AS n, count(*) FILTER (passed) AS n_passed, round(avg(CAST(passed AS INT)) * 100, 1) AS pass_pct, round(avg(CAST(cit AS INT)) * 100, 1) AS citation_pct, round(avg(w), 1) AS avg_words, round(avg(turn), 0) AS avg_latency_ms"
SQL_ANSWERS = f"""
WITH f AS (SELECT role AS case_type, turn, {S.contains_any('lower(text)', _CITE)} AS cit, {S.contains_any('lower(text)', _NONE)} AS fb, turn % 4 = 0 OR contains(lower(text), 'er') OR contains(lower(text), 'zz') AS kw, {S.word_count('text')} AS w FROM conversations),
 p AS (SELECT *, CASE WHEN turn % 5 = 0 THEN fb ELSE kw AND cit END AS passed FROM f)
SELECT case_type, {_A} FROM p GROUP BY 1 UNION ALL SELECT 'ALL', {_A} FROM p"""


# ------------------------------------------------------------------ streaming
def _run(query):
    query.awaitTermination()


def _base(spark) -> str:
    return f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def _in_batches(spark, table: DataFrame, base: str, by: str, newest_first: bool, again: DataFrame | None = None):
    """A stream that brings the table in four batches by ranges of ``by``; from the second on a
    batch also brings the rows ``again`` of the one before."""
    top = table.agg(F.max(by)).first()[0] or 0
    quarter = lambda df, k: df.filter(F.greatest(F.least(F.floor(F.col(by) * 4 / (top + 1)), F.lit(3)), F.lit(0)) == k)
    begin = 1_700_000_000_000
    for n, k in enumerate(sorted(range(4), reverse=newest_first)):
        rows = quarter(table, k)
        if again is not None and n:
            rows = rows.unionByName(quarter(again, k - 1))
        before = set(files.names(spark, f"{base}/in"))
        rows.repartition(2).write.mode("append").parquet(f"{base}/in")
        for name in set(files.names(spark, f"{base}/in")) - before:  # files are taken by their time
            files.set_time(spark, f"{base}/in/{name}", begin + 1000 * n)
    return incremental.read_stream(spark, f"{base}/in", table.schema, files_per_batch=2)


def streamed_documents(spark, d):
    """Stream the documents, some of them twice, into an append-once table and count what arrived."""
    base, docs = _base(spark), load(spark, d, "documents", "doc_id", "lang", "n_chars")
    s = _in_batches(spark, docs, base, "doc_id", newest_first=False, again=docs.filter("doc_id % 3 = 0"))
    _run(incremental.ingest_new(s, f"{base}/out", f"{base}/cp", "doc_id"))
    return spark.read.parquet(f"{base}/out").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


SQL_STREAM_DOCS = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1"


def streamed_upserts(spark, d):
    """Stream the events as upserts per user, newest first; the highest event stays."""
    base = _base(spark)
    s = _in_batches(spark, load(spark, d, "events", "user_id", "event_id", "event_type", "value"), base, "event_id", newest_first=True)
    _run(incremental.ingest_upsert(s, f"{base}/out", f"{base}/cp", "user_id", "event_id"))
    return incremental.read_upserted(spark, f"{base}/out").select("user_id", "event_id", "event_type", "value")


SQL_STREAM_UPSERTS = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def streamed_progress(spark, d):
    """Stream the documents and keep the number of finished ones per language and batch."""
    base = _base(spark)
    s = _in_batches(spark, load(spark, d, "documents", "doc_id", "lang"), base, "doc_id", newest_first=False)
    _run(incremental.track_progress(s, f"{base}/out", f"{base}/cp", "lang"))
    return spark.read.parquet(f"{base}/out").groupBy("lang").agg(F.sum("count").alias("n"), F.countDistinct("epoch").alias("batches"))


SQL_STREAM_PROGRESS = """
SELECT lang, count(*) AS n, count(DISTINCT least(CAST(floor(doc_id * 4 / (SELECT max(doc_id) + 1 FROM documents)) AS INT), 3)) AS batches FROM documents GROUP BY 1"""


def conversation_states(spark, d):
    """Stream the messages through the per-conversation state, in four batches."""
    base = _base(spark)
    s = _in_batches(spark, load(spark, d, "conversations", "conv_id", "turn", "text"), base, "turn", newest_first=False)
    _run(incremental.track_conversations(s, f"{base}/out", f"{base}/cp", 4))
    return incremental.read_conversations(spark, f"{base}/out")


SQL_STATES = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
SELECT conv_id, count(*) AS n_messages, greatest(count(*) - 4, 0) AS summarized_idx, CAST(sum(length(text)) FILTER (b <= 4) AS BIGINT) AS window_chars FROM r GROUP BY 1"""

ENTRIES = {
    "last_turns": (last_turns, SQL_LAST),
    "chat_history": (chat_history, SQL_HISTORY),
    "memory_fit": (memory_fit, SQL_FIT),
    "memory_resume": (memory_resume, SQL_RESUME),
    "token_totals": (token_totals, SQL_TOKENS),
    "prompts": (prompts, SQL_PROMPTS),
    "fallback_questions": (fallback_questions, SQL_FALLBACK),
    "chat_export": (chat_export, SQL_EXPORT),
    "answer_checks": (answer_checks, SQL_ANSWERS),
    "streamed_documents": (streamed_documents, SQL_STREAM_DOCS),
    "streamed_progress": (streamed_progress, SQL_STREAM_PROGRESS),
    "streamed_upserts": (streamed_upserts, SQL_STREAM_UPSERTS),
    "conversation_states": (conversation_states, SQL_STATES),
}
