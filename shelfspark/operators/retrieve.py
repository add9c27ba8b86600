"""Fusion, reranking, gating, pools and score display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.config import SearchConfig
from shelfspark.functions.fold import tokenize
from shelfspark.operators.bm25 import Queries
from shelfspark.operators.keyed import top_per_key
from shelfspark.session import let

Scorer = Callable[[Column, Column], Column]


def fuse(lexical: DataFrame, vector: DataFrame, k: int, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists per query.

    The full outer join of the lists is a union with one aggregate per (query, document).
    A list that lacks the document shows rank -1 and score 0.
    """
    def leg(df: DataFrame, name: str, weight: float) -> DataFrame:
        other = "vector" if name == "bm25" else "bm25"
        return df.select(
            "query_id", "doc_id", (F.lit(weight) / (F.lit(cfg.rrf_k) + F.col("rank") + 1)).alias("part"),
            F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"),
            F.lit(0.0).alias(f"{other}_score"), F.lit(-1).cast("long").alias(f"{other}_rank"))

    both = leg(lexical, "bm25", cfg.bm25_weight).unionByName(leg(vector, "vector", cfg.vector_weight))
    # The two lists hold a document at most once each, so max() picks the present side's rank
    # and sum() its score.
    fused = both.groupBy("query_id", "doc_id").agg(
        F.round(F.sum("part"), 8).alias("score"),
        F.sum("bm25_score").alias("bm25_score"), F.max("bm25_rank").alias("bm25_rank"),
        F.sum("vector_score").alias("vector_score"), F.max("vector_rank").alias("vector_rank"))
    return top_per_key(fused, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of the distinct query words that occur in the text; the offline default."""
    def score(q: Column) -> Column:
        hit = F.size(F.array_intersect(q, F.array_distinct(tokenize(text)))).cast("double")
        return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(hit / F.size(q), 6))

    return let(F.array_distinct(tokenize(query)), score)


def attach_text(candidates: DataFrame, docs: DataFrame, queries: Queries, per_query: int,
                doc_id: str = "doc_id", text: str = "text", chars: int | None = None) -> DataFrame:
    """Bring the text to a candidate list; the list is the small side, the corpus stays in place.

    ``chars``: as many characters as the caller reads. They are cut where the corpus is read, so a
    list too large to broadcast shuffles these and no whole texts.
    """
    read = F.col(text) if chars is None else F.substring(F.col(text), 1, chars)
    corpus = docs.select(F.col(doc_id).alias("doc_id"), read.alias("text"))
    return corpus.join(queries.small(candidates, per_query), "doc_id")


def rerank(candidates: DataFrame, docs: DataFrame, queries: Queries, per_query: int, k: int | None = None,
           scorer: Scorer = overlap_scorer, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Score (query, first characters of the text) pairs again and rank by that score."""
    pairs = attach_text(candidates, docs, queries, per_query, chars=cfg.rerank_chars).join(queries.small(queries.df), "query_id")
    scored = (pairs.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
              .withColumn("score", F.col("rerank_score")).drop("text", "query", "rank"))
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k or per_query)


def above_threshold(reranked: DataFrame, threshold: float) -> DataFrame:
    return reranked.filter(F.col("rerank_score") >= threshold)


def gate(results: DataFrame, queries: Queries, k: int, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Per query: numbered contexts, or a status saying why there are none.

    status is 'empty', 'blocked' (best score too low), 'low_confidence' or 'ok'.
    """
    best = results.filter(F.col("rank") == 0).select("query_id", F.col("score").alias("top_score"))
    state = queries.df.select("query_id").join(queries.small(best), "query_id", "left").withColumn(
        "status", F.when(F.col("top_score").isNull(), "empty")
        .when(F.col("top_score") < cfg.block_below, "blocked")
        .when(F.col("top_score") < cfg.warn_below, "low_confidence").otherwise("ok"))
    shown = results.filter(F.col("rank") < k).select(
        "query_id", "doc_id", "score", (F.col("rank") + 1).alias("source_idx"))
    state = state.withColumn("_open", F.when(F.col("status").isin("ok", "low_confidence"), F.col("query_id")))
    shown = shown.withColumnRenamed("query_id", "_open")
    return state.join(queries.small(shown, k), "_open", "left").select("query_id", "status", "source_idx", "doc_id", "score")


def merge_pool(pool: DataFrame, new: DataFrame, queries: Queries, docs: DataFrame | None = None,
               scorer: Scorer | None = overlap_scorer, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Accumulated pool with new results written over it, the head scored again.

    Only the best ``pool_rerank`` entries get a new score and are sorted by it; the
    rest follow in their old order, up to ``pool_max`` entries in all.
    """
    cols = ["query_id", "doc_id", "score"]
    both = pool.select(*cols, F.lit(0).alias("_gen")).unionByName(new.select(*cols, F.lit(1).alias("_gen")))
    merged = both.groupBy("query_id", "doc_id").agg(F.max_by("score", "_gen").alias("score"))
    ranked = top_per_key(merged, ["query_id"], [F.col("score").desc(), F.col("doc_id")], cfg.pool_max, "old_rank")
    if scorer is None:
        return ranked.withColumn("rank", F.col("old_rank"))
    head = F.col("old_rank") < cfg.pool_rerank
    texted = attach_text(ranked.filter(head), docs, queries, cfg.pool_rerank, chars=cfg.rerank_chars).join(queries.small(queries.df), "query_id")
    again = texted.select("query_id", "doc_id", scorer(F.col("query"), F.col("text")).alias("score"), "old_rank")
    final = again.unionByName(ranked.filter(~head))
    tail = (~head).cast("int")
    place = F.when(head, F.lit(0)).otherwise(F.col("old_rank"))
    return top_per_key(final, ["query_id"], [tail, place, F.col("score").desc(), F.col("doc_id")], cfg.pool_max)


def retrieve(results: DataFrame, queries: Queries, k: int, pool: DataFrame | None = None, docs: DataFrame | None = None,
             scorer: Scorer | None = overlap_scorer, cfg: SearchConfig = SearchConfig()) -> tuple[DataFrame, DataFrame]:
    """Contexts and updated pool of every query: new results, merged with what was found before.

    Contexts are (query_id, status, source_idx, doc_id, score), numbered from 1 and at most
    ``k``; a query without any keeps one row that says why. The gate on the best score holds for
    queries without a pool only; 'low_confidence' is judged on the first context after merging.
    """
    new = results.select("query_id", "doc_id", "score", "rank")
    if pool is None:
        known, merged = None, new
    else:
        known = queries.small(pool.select("query_id").distinct())
        old = merge_pool(pool, new.join(known, "query_id", "left_semi"), queries, docs, scorer, cfg).select("query_id", "doc_id", "score", "rank")
        fresh = new.join(known, "query_id", "left_anti")
        merged = old.unionByName(fresh)
    shut = new.filter((F.col("rank") == 0) & (F.col("score") < cfg.block_below)).select("query_id")
    if known is not None:
        shut = shut.join(known, "query_id", "left_anti")
    shut = queries.small(shut)
    merged = merged.join(shut, "query_id", "left_anti")
    first = merged.filter(F.col("rank") == 0).select("query_id", F.col("score").alias("top"))
    state = (queries.df.select("query_id").join(queries.small(first), "query_id", "left").join(shut.withColumn("shut", F.lit(True)), "query_id", "left")
             .select("query_id", F.when(F.col("shut"), "blocked").when(F.col("top").isNull(), "empty")
                     .when(F.col("top") < cfg.warn_below, "low_confidence").otherwise("ok").alias("status")))
    shown = merged.filter(F.col("rank") < k).select("query_id", (F.col("rank") + 1).alias("source_idx"), "doc_id", "score")
    contexts = state.join(queries.small(shown, k), "query_id", "left").select("query_id", "status", "source_idx", "doc_id", "score")
    return contexts, merged.filter(F.col("rank") < cfg.pool_max)


def display_percent(results: DataFrame) -> DataFrame:
    """Bar length per result: scores scaled to 12..100 within the query."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    pct = F.when(hi == lo, F.lit(100)).otherwise((F.lit(12) + F.lit(88) * (F.col("score") - lo) / (hi - lo)))
    return results.withColumn("bar_pct", F.floor(pct).cast("long"))
