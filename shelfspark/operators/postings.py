"""Postings of a saved index in blocks by range of documents, searched from the highest bound down.

Documents are dealt by a hash of their id into ranges of about RANGE_DOCS; a block holds the postings
of one term in one range and the highest contribution among them. For a query, the bounds of a
range are the sums over its terms. Ranges are scored in descending order of their bound until the next bound
cannot reach the k-th best score: blocks beyond it are not opened. A shard of SHARD_RANGES
ranges is searched by one task, all shards side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import Bm25Config

RANGE_DOCS, SHARD_RANGES = 128, 512
#: Terms whose idf is broadcast while blocks are made.
_SENT_TERMS = 1 << 18
#: Ranges scored before the bound is looked at again.
_STEP = 16
#: Scores are rounded to six digits, so bounds this much lower can still tie.
_MARGIN = 2e-6


def contribution(tf: Column, dl: Column, avgdl: float, cfg: Bm25Config) -> Column:
    """What one term adds to a document, before its weight."""
    tf = tf.cast("double")
    return tf * F.lit(cfg.k1 + 1) / (tf + F.lit(cfg.k1) * (F.lit(1 - cfg.b) + F.lit(cfg.b) * dl.cast("double") / F.lit(avgdl)))


def blocks(doc_terms: DataFrame, stats: DataFrame, n_docs: int, avgdl: float, cfg: Bm25Config) -> DataFrame:
    """(term, idf, shard, rng, top, docs, parts), sorted by term within ranges of terms.

    Postings are shuffled once, by ranges of term and document range, which groups and sorts them. Terms that hold
    at least a _SENT_TERMS-th of the postings (so _SENT_TERMS terms at most) get their idf from a broadcast before;
    only the postings of the rarer ones meet it by a shuffle.
    """
    n_ranges = max(1, -(-n_docs // RANGE_DOCS))
    rng = F.pmod(F.xxhash64("doc_id"), F.lit(n_ranges))
    flat = doc_terms.select(rng.alias("rng"), "doc_id", "dl", F.explode("terms").alias("t"))
    post = flat.select("t.term", "rng", "doc_id", contribution(F.col("t.tf"), F.col("dl"), avgdl, cfg).alias("part"))
    least = (stats.agg(F.sum("df")).first()[0] or 0) / _SENT_TERMS
    often = F.broadcast(stats.filter(F.col("df") >= least).select("term", "idf"))
    rare = stats.filter(F.col("df") < least).select("term", "idf")
    told = post.join(often, "term").unionByName(post.join(often, "term", "left_anti").join(rare, "term")) if least > 1 else post.join(often, "term")
    held = told.repartitionByRange("term", "rng").groupBy("term", "rng").agg(  # about RANGE_DOCS each
        F.first("idf").alias("idf"), F.max("part").alias("top"), F.collect_list(F.struct("doc_id", "part")).alias("p"))
    return held.select("term", "idf", F.floor(F.col("rng") / F.lit(SHARD_RANGES)).alias("shard"), "rng", "top", F.col("p.doc_id").alias("docs"),
                       F.col("p.part").alias("parts")).sortWithinPartitions("term", "rng")


def search_blocks(found: DataFrame, asked: dict[str, list[tuple[int, int]]], n_queries: int, k: int) -> DataFrame:
    """(q, doc_id, raw): the best ``k`` per query number of every shard. ``asked`` gives for a term the
    queries that hold it and how often."""
    kind = found.schema["docs"].dataType.elementType.simpleString()

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        column = lambda name: shard.column(name).combine_chunks() if isinstance(shard.column(name), pa.ChunkedArray) else shard.column(name)
        uses = [asked.get(t, []) for t in shard.column("term").to_pylist()]
        row = np.repeat(np.arange(len(uses)), [len(u) for u in uses])
        query = np.array([q for u in uses for q, _ in u], np.int64)
        weight = np.array([n for u in uses for _, n in u], float) * shard.column("idf").to_numpy()[row]
        rng, top = shard.column("rng").to_numpy(), shard.column("top").to_numpy()
        docs, parts = column("docs"), column("parts")
        out_q, out_doc, out_score = [], [], []
        for q in range(n_queries):
            mine = np.flatnonzero(query == q)
            if len(mine):
                doc, score = _best(docs, parts, row[mine], weight[mine], rng[row[mine]], top[row[mine]], k)
                out_q.append(np.full(len(score), q))
                out_doc.append(doc)
                out_score.append(score)
        doc_type = docs.type.value_type
        return pa.table({"q": pa.array(np.concatenate(out_q) if out_q else [], pa.int64()), "doc_id": pa.concat_arrays(out_doc) if out_doc else pa.array([], doc_type),
                         "raw": pa.array(np.concatenate(out_score) if out_score else [], pa.float64())})
    return found.select("shard", "rng", "term", "idf", "top", "docs", "parts").groupBy("shard").applyInArrow(run, f"q long, doc_id {kind}, raw double")


def _best(docs: pa.ListArray, parts: pa.ListArray, row: np.ndarray, weight: np.ndarray, rng: np.ndarray, top: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The best ``k`` documents of one query: ranges by descending bound, until none can reach the k-th."""
    ranges, own = np.unique(rng, return_inverse=True)
    # Negative weights only lower a score: a document may hold none of these terms.
    bound = np.bincount(own, np.maximum(weight * top, 0.0))
    order = np.argsort(-bound, kind="stable")
    by_range = np.argsort(own, kind="stable")
    first = np.searchsorted(own[by_range], np.arange(len(ranges) + 1))
    best_doc, best = None, np.empty(0)
    for at in range(0, len(order), _STEP):
        if len(best) >= k and bound[order[at]] < best[k - 1] - _MARGIN:
            break
        pick = np.concatenate([by_range[first[r]:first[r + 1]] for r in order[at:at + _STEP]])
        opened, values = docs.take(pa.array(row[pick])), parts.take(pa.array(row[pick]))
        many = np.diff(opened.offsets.to_numpy())
        coded = opened.flatten().dictionary_encode()
        score = np.bincount(coded.indices.to_numpy(zero_copy_only=False), values.flatten().to_numpy() * np.repeat(weight[pick], many))
        best_doc = coded.dictionary if best_doc is None else pa.concat_arrays([best_doc, coded.dictionary])
        best = np.concatenate([best, score])
        if len(best) > k:  # everything that may tie with the k-th stays
            keep = np.flatnonzero(best >= np.partition(best, -k)[-k] - _MARGIN)
            keep = keep[np.argsort(-best[keep], kind="stable")]
            best_doc, best = best_doc.take(pa.array(keep)), best[keep]
        else:
            keep = np.argsort(-best, kind="stable")
            best_doc, best = best_doc.take(pa.array(keep)), best[keep]
    return best_doc, best
