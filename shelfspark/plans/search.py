"""Search modes over a query batch, their comparison and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import EVAL_KS, Bm25Config, SearchConfig
from shelfspark.operators import bm25, evaluate, retrieve, vectors
from shelfspark.operators.bm25 import LexicalIndex, Queries
from shelfspark.operators.retrieve import Scorer, overlap_scorer
from shelfspark.session import materialize

MODES = ("bm25", "vector", "hybrid", "hybrid_rerank")
_COLUMNS = ["query_id", "doc_id", "score", "rank"]


class Library:
    """A searchable collection: texts, lexical index and vectors, each a table."""

    def __init__(self, docs: DataFrame, index: LexicalIndex, doc_vectors: DataFrame, embed_query: vectors.Embedder,
                 cfg: SearchConfig = SearchConfig(), bm25_cfg: Bm25Config = Bm25Config(), scorer: Scorer = overlap_scorer):
        self.docs, self.index, self.vectors, self.embed_query = docs, index, doc_vectors, embed_query
        self.cfg, self.bm25_cfg, self.scorer = cfg, bm25_cfg, scorer

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", embedder: vectors.Embedder | None = None,
              store: bool = True, **kw) -> Library:
        """Index a text table. ``store`` writes index and vectors once for repeated use."""
        embedder = embedder or vectors.hashing_embedder()
        told = [F.col(f.name) for f in docs.schema.fields if f.name not in (doc_id, text, "doc_id", "text")]
        full = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *told)
        d = full.select("doc_id", "text")
        index = LexicalIndex.build(d)
        vecs = vectors.embed(d, embedder, "text").select("doc_id", "embedding")
        if store:
            index, vecs = index.stored(), materialize(vecs, "vectors")
        return cls(full, index, vecs, embedder, **kw)

    def lexical(self, q: Queries, k: int) -> DataFrame:
        return bm25.search(self.index, q, k, self.bm25_cfg)

    def vector(self, q: Queries, k: int) -> DataFrame:
        return vectors.nearest(self.vectors, vectors.embed(q.df, self.embed_query, "query"), k)

    def hybrid(self, q: Queries, k: int) -> DataFrame:
        n = k * self.cfg.candidate_mult
        return retrieve.fuse(self.lexical(q, n), self.vector(q, n), k, self.cfg)

    def reranked(self, q: Queries, k: int) -> DataFrame:
        """Fused candidates, scored again, cut to ``k``. At least ``k`` candidates are scored."""
        n = max(k, self.cfg.n_rerank)
        return retrieve.rerank(self.hybrid(q, n), self.docs, q, n, k, self.scorer, self.cfg)

    def search(self, q: Queries, k: int | None = None, mode: str = "hybrid_rerank") -> DataFrame:
        k = k or self.cfg.top_k
        run = {"bm25": self.lexical, "vector": self.vector, "hybrid": self.hybrid, "hybrid_rerank": self.reranked}
        if mode not in run:
            raise ValueError(f"mode must be one of {MODES}")
        return run[mode](q, k)

    def compare(self, q: Queries, k: int | None = None, modes=MODES) -> DataFrame:
        """Results of every mode side by side.

        The two ranked lists are computed once, to the longest length any mode needs, and
        each mode is cut from them.
        """
        k = k or self.cfg.top_k
        n_rr = max(k, self.cfg.n_rerank)
        longest = n_rr * self.cfg.candidate_mult
        lex = materialize(self.lexical(q, longest), "lexical")
        vec = materialize(self.vector(q, longest), "nearest")
        top = lambda df, n: df.filter(F.col("rank") < n)
        n = k * self.cfg.candidate_mult
        out = {
            "bm25": lambda: top(lex, k), "vector": lambda: top(vec, k),
            "hybrid": lambda: retrieve.fuse(top(lex, n), top(vec, n), k, self.cfg),
            "hybrid_rerank": lambda: retrieve.rerank(retrieve.fuse(lex, vec, n_rr, self.cfg), self.docs, q, n_rr, k, self.scorer, self.cfg),
        }
        res = None
        for m in modes:
            df = out[m]().select(F.lit(m).alias("mode"), *_COLUMNS)
            res = df if res is None else res.unionByName(df)
        return res

    def evaluate(self, tests: DataFrame, ks=EVAL_KS, modes=MODES) -> DataFrame:
        """Per (mode, query, k) metrics of ``tests(query_id, query, query_type, keywords)``."""
        q = Queries.of(tests)
        found = self.compare(q, max(ks), modes)
        # A result is judged by its text and by everything else that is told about it in words.
        told = [f.name for f in self.docs.schema.fields if f.dataType.simpleString() == "string" and f.name not in ("text", "doc_id")]
        all_of_it = F.concat_ws(" ", "text", *told).alias("text")
        texted = retrieve.attach_text(found, self.docs.select("doc_id", all_of_it), q, max(ks) * len(modes))
        flags = texted.join(q.small(tests.select("query_id", "keywords")), "query_id").select(
            "mode", "query_id", "rank", evaluate.is_relevant(F.col("text"), F.col("keywords")).alias("relevant"))
        ran = tests.select(F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), "query_id", "query_type")
        return evaluate.query_metrics(flags, ran, ks)
