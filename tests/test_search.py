import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.config import SearchConfig
from shelfspark.operators import retrieve, vectors
from shelfspark.operators.bm25 import LexicalIndex, Queries, search
from shelfspark.plans.search import MODES, Library

TEXTS = ["red fox jumps", "red red dog", "blue fox and red fox", "green tree", "red sky at night red", "", "fox fox fox fox tree"]
ASKED = ["red fox", "tree tree green", "unknown words", "fox red red", "!!"]


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = [[w for w in re.findall(r"\w+", d) if len(w) > 1] for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for i, t in enumerate(toks):
        c = Counter(t)
        s = sum(idf.get(q, 0) * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * len(t) / avg)) for q in query if c[q])
        if any(c[q] for q in query):
            out.append((round(s, 6), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return Queries.of(spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_bm25_equals_brute_force(docs, queries):
    got = rows(search(LexicalIndex.build(docs), queries, 3), "query_id", "rank", "doc_id", "score")
    want = []
    for q, text in enumerate(ASKED):
        ranked = okapi(TEXTS, [w for w in re.findall(r"\w+", text) if len(w) > 1])[:3]
        want += [(q, r, d, s) for r, (s, d) in enumerate(ranked)]
    assert got == sorted(want)


def test_bm25_same_for_any_partitioning(spark, docs, queries):
    base = rows(search(LexicalIndex.build(docs), queries, 5), "query_id", "rank", "doc_id", "score")
    for parts in (1, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        shuffled = docs.orderBy(F.rand(parts)).repartition(parts)
        assert rows(search(LexicalIndex.build(shuffled), queries, 5), "query_id", "rank", "doc_id", "score") == base
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_saved_index_gives_the_same_result(spark, docs, queries, tmp_path):
    ix = LexicalIndex.build(docs)
    ix.save(str(tmp_path / "ix"))
    base = rows(search(ix, queries, 5), "query_id", "rank", "doc_id", "score")
    assert rows(search(LexicalIndex.load(spark, str(tmp_path / "ix")), queries, 5), "query_id", "rank", "doc_id", "score") == base


def test_documents_are_scored_where_they_are_read(spark, docs, queries, tmp_path):
    index = LexicalIndex.build(docs).stored()
    plan = search(index, queries, 5)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and all("doc_id" not in line for line in shuffled) and "MapInArrow" in plan
    index.save(str(tmp_path / "ix"))
    saved = LexicalIndex.load(spark, str(tmp_path / "ix"))
    few = Queries(queries.df, queries.rows, queries.chars)
    plan = search(saved, few, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), In(term" in plan or "In(term" in plan


def test_bucketed_index_scores_without_shuffling_postings(spark, docs, queries):
    LexicalIndex.build(docs).save_table("shelf_ix", 4)
    found = search(LexicalIndex.load_table(spark, "shelf_ix"), queries, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)
    assert rows(found, "query_id", "rank", "doc_id", "score") == rows(search(LexicalIndex.build(docs), queries, 5), "query_id", "rank", "doc_id", "score")


def test_term_stats_prune_to_the_vocabulary(docs):
    plan = LexicalIndex.build(docs).stored().term_stats()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,df:bigint>" in plan


def _vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)), spark


def test_nearest_equals_brute_force_in_both_forms(spark):
    v, _ = _vectors(spark, 60, 8, 1)
    q, _ = _vectors(spark, 7, 8, 2)
    vd = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(5)
    qd = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    sims = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T, 6)
    want = sorted((j, r, int(i), float(sims[i, j])) for j in range(7)
                  for r, i in enumerate(sorted(range(60), key=lambda i: (-sims[i, j], i))[:4]))
    assert rows(vectors.nearest(vd, qd, 4), "query_id", "rank", "doc_id", "score") == want
    assert rows(vectors.nearest(vd, qd, 4, max_bytes=200), "query_id", "rank", "doc_id", "score") == want


def test_hashing_embedder_is_unit_length(spark, docs):
    v = vectors.embed(docs, vectors.hashing_embedder(16), "text").collect()
    for r in v:
        assert abs(sum(x * x for x in r["embedding"]) - (1 if r["text"] else 0)) < 1e-6


def test_model_embedder_takes_a_prefix(docs):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = vectors.embed(docs, vectors.model_embedder(load, "passage: "), "text").filter("doc_id = 5").first()["embedding"]
    assert got == pytest.approx([9 / math.sqrt(82), 1 / math.sqrt(82)])


def _ranked(spark, data):
    return spark.createDataFrame(data, "query_id long, doc_id long, score double, rank long")


def test_fusion_is_symmetric_and_marks_absence(spark):
    a = _ranked(spark, [(0, 1, 9.0, 0), (0, 2, 8.0, 1)])
    b = _ranked(spark, [(0, 2, 0.9, 0), (0, 3, 0.8, 1)])
    ab = {r["doc_id"]: r for r in retrieve.fuse(a, b, 10).collect()}
    ba = {r["doc_id"]: r for r in retrieve.fuse(b, a, 10).collect()}
    assert {d: r["score"] for d, r in ab.items()} == {d: r["score"] for d, r in ba.items()}
    assert ab[2]["score"] == round(.5 / 62 + .5 / 61, 8) and ab[2]["rank"] == 0
    assert (ab[3]["bm25_rank"], ab[3]["bm25_score"], ab[1]["vector_rank"]) == (-1, 0.0, -1)


def test_pool_keeps_tail_order_and_overwrites(spark, docs):
    q = Queries.of(spark.createDataFrame([(0, "fox tree")], "query_id long, query string"))
    pool = _ranked(spark, [(0, 0, 5.0, 0), (0, 3, 4.0, 1), (0, 4, 1.0, 2)])
    new = _ranked(spark, [(0, 4, 9.0, 0), (0, 6, 2.0, 1)])
    cfg = SearchConfig(pool_rerank=2, pool_max=3)
    got = [(r["doc_id"], r["score"]) for r in retrieve.merge_pool(pool, new, q, docs, cfg=cfg).orderBy("rank").collect()]
    assert got == [(0, 0.5), (4, 0.0), (3, 4.0)]


def test_gate_states(spark):
    q = Queries.of(spark.createDataFrame([(i, "x") for i in range(4)], "query_id long, query string"))
    found = _ranked(spark, [(0, 1, 0.5, 0), (0, 2, 0.4, 1), (1, 1, 0.005, 0), (2, 1, 0.001, 0)])
    got = rows(retrieve.gate(found, q, 1), "query_id", "status")
    assert got == [(0, "ok"), (1, "low_confidence"), (2, "blocked"), (3, "empty")]


def test_every_mode_and_metric_bounds(spark, docs):
    lib = Library.build(docs)
    tests = spark.createDataFrame([(0, "red fox", "FACTUAL", ["fox"]), (1, "zzz", "AUTHOR", ["nothing"]), (2, "tree", "SEMANTIC", ["GREEN"])],
                                  "query_id long, query string, query_type string, keywords array<string>")
    m = lib.evaluate(tests, ks=(1, 3)).collect()
    assert len(m) == len(MODES) * 3 * 2
    assert all(0 <= r[c] <= 1 for r in m for c in ("precision", "recall_simplified", "f1", "mrr"))
    one = {(r["mode"], r["query_id"], r["k"]): r for r in m}
    assert one[("bm25", 0, 1)]["precision"] == 1.0 and one[("bm25", 1, 3)]["n_retrieved"] == 0
    assert one[("bm25", 2, 3)]["mrr"] == 1.0
    with pytest.raises(ValueError):
        lib.search(Queries.of(tests), mode="other")


def test_compare_equals_single_modes(spark, docs, queries):
    lib = Library.build(docs)
    both = lib.compare(queries, 3)
    for mode in MODES:
        alone = rows(lib.search(queries, 3, mode), "query_id", "doc_id", "score", "rank")
        assert rows(both.filter(F.col("mode") == mode), "query_id", "doc_id", "score", "rank") == alone


def test_blocks_over_many_ranges_and_shards(spark, tmp_path, monkeypatch):
    """Ranges are left out by their bounds only: the saved index gives what the scan gives."""
    import random

    from shelfspark.operators import postings
    monkeypatch.setattr(postings, "RANGE_DOCS", 16)
    monkeypatch.setattr(postings, "SHARD_RANGES", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(1, 40)))) for i in range(1500)]
    texts += [(5000 + i, "w50 w51 w52") for i in range(40)]  # ties
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    q = Queries.of(spark.createDataFrame([(0, "w1 w30 w59"), (1, "w50 w51 w52 w50"), (2, "nothing"), (3, "w0 w0 w1 w2")], "query_id long, query string"))
    index = LexicalIndex.build(d)
    index.save(str(tmp_path / "ix"))
    saved = LexicalIndex.load(spark, str(tmp_path / "ix"))
    for k in (1, 7, 60):
        found = search(saved, q, k)
        assert rows(found, "query_id", "rank", "doc_id", "score") == rows(search(index, q, k), "query_id", "rank", "doc_id", "score")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<term:string,idf:double,shard:bigint" in plan


def test_ranges_below_the_bound_are_not_opened():
    import pyarrow as pa

    from shelfspark.operators import postings
    n = 400
    top = np.r_[np.full(20, 5.0), np.full(n - 20, 1.0)]
    docs = pa.array([[i] for i in range(n)], pa.list_(pa.int64()))

    class Counted:
        def __init__(self, array):
            self.array, self.rows = array, 0

        def take(self, at):
            self.rows += len(at)
            return self.array.take(at)
    parts = Counted(pa.array([[x] for x in top], pa.list_(pa.float64())))
    best, score = postings._best(docs, parts, np.arange(n), np.ones(n), np.arange(n), top, 10)
    assert sorted(best.to_pylist())[:10] == list(range(10)) and score[0] == 5.0 and parts.rows <= 48


def test_every_term_is_told(spark, tmp_path):
    """One row per term, also where terms share first letter and frequency."""
    from shelfspark.plans.registry.search import bm25_terms
    spark.createDataFrame([(1, "alpha avocado beta"), (2, "alpha anchor"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(bm25_terms(spark, str(tmp_path)), "term", "df")
    assert got == [("alpha", 2), ("anchor", 1), ("avocado", 1), ("beta", 1)]


def test_embedding_holds_a_slice_of_words_at_once(spark, monkeypatch):
    """Rows of any length: the words of a batch are cut to slices of whole rows, none is lost."""
    import pyarrow as pa

    from shelfspark.operators import vectors
    monkeypatch.setattr(vectors, "_WORDS", 10)
    lists = pa.array([["a"] * 4, ["b"] * 6, [], None, ["c"] * 25, ["d"], []], pa.list_(pa.string()))
    parts = [p.to_pylist() for p in vectors.slices(lists)]
    assert sum(parts, []) == lists.to_pylist()
    assert [sum(len(r or []) for r in p) for p in parts] == [10, 25, 1] and list(vectors.slices(lists.slice(0, 0))) == []
    whole, cut = vectors._hashed(lists, 8), pa.concat_arrays([vectors._hashed(p, 8) for p in vectors.slices(lists)])
    assert whole.equals(cut) and whole.to_pylist()[2] == [0.0] * 8


@pytest.mark.parametrize("sent", [2, 1 << 18])
def test_blocks_shuffle_postings_once(spark, monkeypatch, sent):
    """Every posting is in a block, with its idf, whether that is broadcast or not; one shuffle where it is."""
    from shelfspark.config import Bm25Config
    from shelfspark.operators import postings
    monkeypatch.setattr(postings, "_SENT_TERMS", sent)
    monkeypatch.setattr(postings, "RANGE_DOCS", 4)
    d = spark.createDataFrame([(i, f"all half{i % 2} own{i}") for i in range(30)], "doc_id long, text string")
    index = LexicalIndex.build(d).stored()
    stats = index.term_stats()
    b = postings.blocks(index.doc_terms, stats, 30, 3.0, Bm25Config())
    idf = {r["term"]: r["idf"] for r in stats.collect()}
    got = b.collect()
    assert sorted((r["term"], i) for r in got for i in r["docs"]) == sorted((t, i) for i in range(30) for t in ("all", f"half{i % 2}", f"own{i}"))
    assert len({(r["term"], r["rng"]) for r in got}) == len(got) and all(r["idf"] == idf[r["term"]] and r["top"] == max(r["parts"]) for r in got)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and (sent == 2 or plan.count("Repartition") == 1)
