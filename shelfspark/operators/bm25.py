"""Lexical index and Okapi BM25 search for a whole batch of queries in one plan."""

from __future__ import annotations

import functools
import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.config import Bm25Config
from shelfspark.functions.fold import term_counts, tokenize
from shelfspark.operators import postings, vectors
from shelfspark.operators.keyed import top_per_key
from shelfspark.session import BROADCAST_MAX_ROWS, explode_once, materialize, small_side
from shelfspark.sources import files


class Queries:
    """A batch of queries ``(query_id, query)``; its size is measured when it is first asked for."""

    def __init__(self, df: DataFrame, rows: int | None = None, chars: int | None = None):
        self.df = df
        if rows is not None and chars is not None:
            self.size = (rows, chars)

    @functools.cached_property
    def size(self) -> tuple[int, int]:
        """Queries and characters."""
        return tuple(self.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("query")), F.lit(0))).first())

    @property
    def rows(self) -> int:
        return self.size[0]

    @property
    def chars(self) -> int:
        return self.size[1]

    @classmethod
    def of(cls, df: DataFrame, query_id: str = "query_id", query: str = "query") -> Queries:
        return cls(df.select(F.col(query_id).alias("query_id"), F.col(query).alias("query")))

    def few(self, n: int) -> list | None:
        """The counted words of at most ``n`` queries; None where there are more."""
        head = self.df.limit(n + 1).select("query_id", term_counts(tokenize("query")).alias("terms")).collect()
        return head if len(head) <= n else None

    def small(self, df: DataFrame, per_query: int = 1) -> DataFrame:
        """Broadcast a table of at most ``per_query`` rows per query when that is small."""
        return small_side(df, self.rows * per_query)

    def terms(self) -> DataFrame:
        """(query_id, term, qtf); repeated words count as often as they occur."""
        return (explode_once(self.df, term_counts(tokenize("query")), "t", "query_id")
                .select("query_id", "t.term", F.col("t.tf").alias("qtf")))

    def small_terms(self, df: DataFrame) -> DataFrame:
        """Broadcast a table of at most one row per query word, bounded by the text size."""
        return small_side(df, self.chars // 3 + self.rows, 96)


@dataclass(frozen=True)
class LexicalIndex:
    """``doc_terms(doc_id, dl, terms)``: one row per document with its counted terms, and
    ``vocabulary(term, df)``.

    Partitioned by document, so one scan scores a document against every query; the
    vocabulary is a partial-aggregated count over it. A saved index also has the idf of its terms,
    its own size, and its postings in ``blocks`` by term: a few queries read the row groups of
    their own words only, and nothing of ``doc_terms``.
    """

    doc_terms: DataFrame
    vocabulary: DataFrame
    blocks: DataFrame | None = None
    made: dict | None = None

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
        tokens = docs.select(F.col(doc_id).alias("doc_id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        return cls.of_terms(tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"),
                                          term_counts("tokens").alias("terms")))

    @classmethod
    def of_terms(cls, doc_terms: DataFrame) -> LexicalIndex:
        return cls(doc_terms, doc_terms.select(F.explode("terms").alias("t")).select("t.term")
                   .groupBy("term").agg(F.count(F.lit(1)).alias("df")))

    def stored(self) -> LexicalIndex:
        """The same index written once to the shared folder, for plans that read it often."""
        docs = LexicalIndex.of_terms(materialize(self.doc_terms, "doc_terms"))
        return LexicalIndex(docs.doc_terms, materialize(docs.vocabulary, "vocabulary"))

    def save(self, path: str, cfg: Bm25Config = Bm25Config()) -> None:
        """Full rebuild of the index folder, with contributions and idf for ``cfg``."""
        spark = self.doc_terms.sparkSession
        self.doc_terms.write.mode("overwrite").parquet(f"{path}/doc_terms")
        saved = LexicalIndex.of_terms(spark.read.schema(self.doc_terms.schema).parquet(f"{path}/doc_terms"))
        size = saved.corpus().first()
        saved.term_stats(cfg).write.mode("overwrite").parquet(f"{path}/vocabulary")
        stats = spark.read.parquet(f"{path}/vocabulary")
        blocks = postings.blocks(saved.doc_terms, stats, size["n_docs"], size["avgdl"] or 1.0, cfg)
        blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        schema = {name: df.schema.json() for name, df in (("doc_terms", saved.doc_terms), ("vocabulary", stats), ("blocks", blocks))}
        made = {"n_docs": size["n_docs"], "n_tokens": size["n_tokens"], "avgdl": size["avgdl"], "cfg": asdict(cfg), "schema": schema}
        files.write_text(spark, f"{path}/made.json", json.dumps(made))

    def save_table(self, table: str, buckets: int) -> None:
        """Bucketed by document: scoring then aggregates per document without a shuffle."""
        (self.doc_terms.repartition(buckets, "doc_id").write.mode("overwrite")
         .bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(f"{table}_docs"))
        spark = self.doc_terms.sparkSession
        LexicalIndex.of_terms(spark.table(f"{table}_docs")).vocabulary.write.mode("overwrite").saveAsTable(f"{table}_terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        made = json.loads(files.read_text(spark, f"{path}/made.json"))
        return cls(*[spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(f"{path}/{t}") for t, kind in made["schema"].items()], made)

    @classmethod
    def load_table(cls, spark: SparkSession, table: str) -> LexicalIndex:
        return cls(spark.table(f"{table}_docs"), spark.table(f"{table}_terms"))

    def postings(self) -> DataFrame:
        return (self.doc_terms.select("doc_id", "dl", F.explode("terms").alias("t"))
                .select("doc_id", "dl", "t.term", "t.tf"))

    def corpus(self) -> DataFrame:
        """One row: documents, mean length."""
        if self.made:
            known = {c: F.lit(self.made[c]).cast(kind).alias(c) for c, kind in (("n_docs", "long"), ("n_tokens", "long"), ("avgdl", "double"))}
            return self.doc_terms.sparkSession.range(1).select(*known.values())
        return self.doc_terms.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens")).select(
            "n_docs", "n_tokens", (F.col("n_tokens").cast("double") / F.col("n_docs")).alias("avgdl"))

    def saved_for(self, cfg: Bm25Config) -> bool:
        return self.made is not None and self.made["cfg"] == asdict(cfg)

    def term_stats(self, cfg: Bm25Config = Bm25Config()) -> DataFrame:
        """(term, df, idf). A negative idf is replaced by epsilon times the mean raw idf.

        The mean is taken over the document-frequency histogram, which has at most as
        many rows as there are distinct counts.
        """
        df = self.vocabulary
        if self.saved_for(cfg):
            return df.select("term", "df", "idf")
        df = df.select("term", "df")
        n = self.corpus().select(F.col("n_docs").cast("double")).scalar()
        raw = F.log(n - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
        mean = (df.groupBy("df").agg(F.count(F.lit(1)).alias("terms")).withColumn("raw", raw)
                .agg((F.sum(F.col("raw") * F.col("terms")) / F.sum("terms")).alias("m"))).scalar()
        return df.withColumn("raw", raw).select(
            "term", "df", F.when(F.col("raw") < 0, F.lit(cfg.epsilon) * mean).otherwise(F.col("raw")).alias("idf"))


def search(index: LexicalIndex, queries: Queries, k: int, cfg: Bm25Config = Bm25Config()) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best ``k`` matching documents per query.

    A document stands in one row, so it is scored against all queries where it is read and a
    task hands on its best ``k`` documents per query: no row per (query, document) is shuffled.
    Up to FEW_QUERIES queries against a saved index open the blocks of their words only.
    Query words that are too many to be sent to the tasks meet the postings by a shuffle.
    Documents without any query word are not returned.
    """
    best = lambda scored: top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    if index.blocks is not None and index.saved_for(cfg):
        head = queries.few(FEW_QUERIES)
        if head is not None:
            return best(_few(index, queries, head, k))
    stats = index.term_stats(cfg)
    weights = stats.join(queries.small_terms(queries.terms()), "term").select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("w"))
    avgdl = index.corpus().select("avgdl")
    if (queries.chars // 3 + queries.rows) > BROADCAST_MAX_ROWS:
        part = F.col("w") * postings.contribution(F.col("tf"), F.col("dl"), avgdl.first()["avgdl"] or 1.0, cfg)
        scored = (index.postings().join(queries.small_terms(weights), "term").withColumn("part", part)
                  .groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")))
    else:
        mean = avgdl.first()["avgdl"]
        scored = _scored_in_tasks(index.doc_terms, weights, float(mean or 1.0), k, cfg)
    return best(scored)


def _few(index: LexicalIndex, queries: Queries, head: list, k: int) -> DataFrame:
    """A few queries over the blocks of their words."""
    asked: dict[str, list[tuple[int, int]]] = {}
    for q, row in enumerate(head):
        for t in row["terms"] or []:
            asked.setdefault(t["term"], []).append((q, t["tf"]))
    found = postings.search_blocks(index.blocks.filter(F.col("term").isin(sorted(asked))), asked, len(head), k)
    ids = F.array(*[F.lit(r["query_id"]).cast(queries.df.schema["query_id"].dataType) for r in head]) if head else F.array(F.lit(None).cast(queries.df.schema["query_id"].dataType))
    return found.select(F.get(ids, F.col("q").cast("int")).alias("query_id"), "doc_id", F.round("raw", 6).alias("score"))


#: Queries that read postings by term; pairs of a posting and a query computed at once.
FEW_QUERIES = 16
_PAIRS = 1 << 19


def _scored_in_tasks(doc_terms: DataFrame, weights: DataFrame, avgdl: float, k: int, cfg: Bm25Config) -> DataFrame:
    """The best ``k`` documents per query of every task; the weights are bounded by the query texts."""
    rows = weights.orderBy("term", "query_id").toArrow()
    terms, start = [], []
    for i, t in enumerate(rows.column("term").to_pylist()):
        if not terms or terms[-1] != t:
            terms.append(t)
            start.append(i)
    asked = rows.column("query_id").to_pylist()
    ids = list(dict.fromkeys(asked))
    number = {q: i for i, q in enumerate(ids)}
    query = np.array([number[q] for q in asked], np.int64)
    shared = doc_terms.sparkSession.sparkContext.broadcast((terms, np.array([*start, len(rows)]), query, rows.column("w").to_numpy(), ids))
    kinds = {f.name: f.dataType.simpleString() for f in [weights.schema["query_id"], doc_terms.schema["doc_id"]]}
    q_type = rows.schema.field("query_id").type
    most = max(1, min(512, _PAIRS // max(1, len(ids))))

    def run(batches):
        words, first, q_of, w_of, q_ids = shared.value
        value_set = pa.array(words, pa.string())
        best = None
        for b in batches:
            at = 0
            for part in vectors.slices(b.column("terms")):  # of at most ``most`` rows: the pairs of a slice and all queries are held
                for lo in range(0, len(part), most):
                    n = min(most, len(part) - lo)
                    best = _best_of(b.slice(at + lo, n), value_set, first, q_of, w_of, avgdl, k, cfg, best)
                at += len(part)
        if best is not None and len(best[0]):
            q, score, docs = best
            yield pa.RecordBatch.from_arrays([pa.array([q_ids[i] for i in q], q_type), docs, pa.array(score)], ["query_id", "doc_id", "raw"])
    found = doc_terms.select("doc_id", "dl", "terms").mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, raw double")
    return found.select("query_id", "doc_id", F.round("raw", 6).alias("score"))


def _best_of(b, value_set, first, q_of, w_of, avgdl, k, cfg, best):
    """The best so far, with the rows of one slice of documents added."""
    lists = b.column("terms")
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    hit = pc.fill_null(pc.index_in(flat.field("term"), value_set), -1).to_numpy(zero_copy_only=False)
    seen = np.flatnonzero(hit >= 0)
    term, doc = hit[seen], doc[seen]
    tf = flat.field("tf").to_numpy(zero_copy_only=False)[seen].astype(float)
    dl = b.column("dl").to_numpy(zero_copy_only=False).astype(float)
    part = tf * (cfg.k1 + 1) / (tf + cfg.k1 * ((1 - cfg.b) + cfg.b * dl[doc] / avgdl))
    many = first[term + 1] - first[term]
    ends = np.cumsum(many)
    cuts = np.searchsorted(ends, np.arange(_PAIRS, ends[-1] + _PAIRS, _PAIRS)) + 1 if len(ends) else []
    keys, sums, lo = [], [], 0
    n_q = int(q_of.max()) + 1 if len(q_of) else 1
    for hi in cuts:  # postings of about _PAIRS pairs with queries at once
        m = many[lo:hi]
        pick = np.repeat(first[term[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        key, back = np.unique(np.repeat(doc[lo:hi], m) * n_q + q_of[pick], return_inverse=True)
        keys.append(key)
        sums.append(np.bincount(back, np.repeat(part[lo:hi], m) * w_of[pick], len(key)))
        lo = hi
    if not keys:
        return best
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    score = np.bincount(back, np.concatenate(sums), len(key))
    q, docs = key % n_q, b.column("doc_id").take(pa.array(key // n_q))
    if best is not None:
        q, score, docs = np.r_[best[0], q], np.r_[best[1], score], pa.concat_arrays([best[2], docs])
    place = pc.rank(docs, tiebreaker="dense").to_numpy()
    order = np.lexsort((place, -np.round(score, 6), q))
    q_sorted = q[order]
    begin = np.flatnonzero(np.r_[True, q_sorted[1:] != q_sorted[:-1]])
    rank = np.arange(len(q_sorted)) - np.repeat(begin, np.diff(np.r_[begin, len(q_sorted)]))
    order = order[rank < k]
    return q[order], score[order], docs.take(pa.array(order))
