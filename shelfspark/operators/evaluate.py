"""Retrieval metrics and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.config import EVAL_KS
from shelfspark.functions.text import word_count
from shelfspark.session import any_of, let


def is_relevant(text: Column, keywords: Column, metadata: list[Column] = ()) -> Column:
    """At least one keyword occurs in the text or the metadata, ignoring case."""
    hay = F.lower(F.concat_ws(" ", text, *metadata))
    return F.exists(keywords, lambda k: hay.contains(F.lower(k)))


def query_metrics(flags: DataFrame, queries: DataFrame, ks=EVAL_KS) -> DataFrame:
    """Per (mode, query, k) from ``flags(mode, query_id, rank, relevant)``.

    ``queries(mode, query_id, query_type)`` names every pair that was run, so a query
    without results still counts. Precision divides by k even when fewer rows came
    back; recall is the simplified one and equals precision.
    """
    hit = F.col("relevant").cast("long")
    per_query = flags.groupBy("mode", "query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_hit"),
        *[F.sum(F.when(F.col("rank") < k, hit)).alias(f"hit_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") < k, F.lit(1))).cast("long").alias(f"got_{k}") for k in ks])
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.coalesce(F.col(f"hit_{k}"), F.lit(0)).alias("hits"),
                               F.coalesce(F.col(f"got_{k}"), F.lit(0)).alias("got")) for k in ks])
    long = queries.join(per_query, ["mode", "query_id"], "left").withColumn("m", F.explode(table))
    p = F.col("m.hits") / F.col("m.k")
    return long.select(
        "mode", "query_id", "query_type", F.col("m.k").alias("k"), p.alias("precision"), p.alias("recall_simplified"),
        F.when(p > 0, 2 * p * p / (p + p)).otherwise(F.lit(0.0)).alias("f1"),
        F.when(F.col("first_hit").isNull(), F.lit(0.0)).otherwise(1.0 / (F.col("first_hit") + 1)).alias("mrr"),
        F.col("m.got").alias("n_retrieved"), F.col("m.hits").alias("n_relevant"))


def macro_average(metrics: DataFrame, decimals: int = 6) -> DataFrame:
    """Means per (mode, k) and per (mode, k, query_type) as two grouping sets of one pass."""
    g = metrics.groupingSets([["mode", "k"], ["mode", "k", "query_type"]], "mode", "k", "query_type")
    return g.agg(F.count(F.lit(1)).alias("n_queries"),
                 *[F.round(F.avg(c), decimals).alias(c) for c in ("precision", "recall_simplified", "f1", "mrr")]
                 ).withColumn("query_type", F.coalesce("query_type", F.lit("ALL")))


def report_json(averages: DataFrame) -> DataFrame:
    """One JSON document per averaged row."""
    return averages.select("mode", "k", "query_type", F.to_json(F.struct(*averages.columns)).alias("report"))


# ------------------------------------------------------------------ answers
def has_marker(answer: Column, markers) -> Column:
    return let(F.lower(answer), lambda low: any_of(low, [m.lower() for m in markers]))


def check_answers(df: DataFrame, answer: str = "answer", keywords: str = "expect_keywords",
                  expect_fallback: str = "expect_fallback", citations=tuple(V.CITATION_MARKERS),
                  fallbacks=tuple(V.FALLBACK_MARKERS)) -> DataFrame:
    """Citation, fallback and keyword flags and the pass rule."""
    a = F.col(answer)
    low = F.lower(a)
    named = (F.size(keywords) == 0) | F.exists(keywords, lambda k: low.contains(F.lower(k)))
    out = (df.withColumn("has_citation", has_marker(a, citations))
           .withColumn("is_fallback", has_marker(a, fallbacks))
           .withColumn("has_keywords", named)
           .withColumn("answer_words", word_count(a)))
    return out.withColumn("passed", F.when(F.col(expect_fallback), F.col("is_fallback"))
                          .otherwise(F.col("has_keywords") & F.col("has_citation")))


def answer_summary(checked: DataFrame, kind: str = "case_type", latency: str | None = None) -> DataFrame:
    """Totals and per-type figures as two grouping sets."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 1)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed"),
            rate("passed").alias("pass_pct"), rate("has_citation").alias("citation_pct"),
            F.round(F.avg("answer_words"), 1).alias("avg_words")]
    if latency:
        aggs.append(F.round(F.avg(latency), 0).alias("avg_latency_ms"))
    return (checked.groupingSets([[], [kind]], kind).agg(*aggs)
            .withColumn(kind, F.coalesce(kind, F.lit("ALL"))))
