import numpy as np
import pytest

from shelfspark.operators import lsh, vectors


def table(spark, x, first=0):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(first, first + len(x)), "embedding": list(x.astype(np.float32))}))


def clustered(n, dim=48, groups=2000, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.45 * rng.normal(size=(n, dim))


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.select("query_id", "doc_id").collect()}


@pytest.mark.parametrize("name", ["clustered", "even"])
def test_recall_at_100_000(spark, name):
    x = clustered(100_000) if name == "clustered" else np.random.default_rng(2).normal(size=(100_000, 48))
    v = table(spark, x)
    q = v.filter("doc_id % 1000 = 7").withColumnRenamed("doc_id", "query_id")
    index = lsh.LshIndex.build(v)
    probes = index.calibrate(10)
    print(name, "bits", index.bits, "probed", probes)
    read = 0.5 if probes is None else index.tables * 2.0 ** (probes - index.bits)
    assert read <= (0.05 if name == "clustered" else 0.5)  # vectors without near neighbours need many buckets
    want, got = pairs(vectors.nearest(v, q, 10)), pairs(lsh.nearest(index, q, 10))
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)


def test_all_probes_are_exact_and_saved(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(700, 8))
    x[300:420] = x[7]  # one bucket that holds many
    v = table(spark, x).unionByName(spark.createDataFrame([(9000, None), (9001, [1.0])], "doc_id long, embedding array<float>"))
    q = table(spark, x[:40]).withColumnRenamed("doc_id", "query_id")
    lsh.LshIndex.build(v, path=str(tmp_path / "index"))
    index = lsh.LshIndex.load(spark, str(tmp_path / "index"))
    cols = ["query_id", "rank", "doc_id", "score"]
    want = sorted(map(tuple, vectors.nearest(v.filter("size(embedding) = 8"), q, 6).select(*cols).collect()))
    assert sorted(map(tuple, lsh.nearest(index, q, 6, probe_bits=64).select(*cols).collect())) == want
    few = lsh.nearest(index, q.filter("query_id < 2"), 6, probe_bits=1)
    assert set(map(tuple, few.select("query_id", "doc_id", "score").collect())) <= set(map(tuple, vectors.nearest(v.filter("size(embedding) = 8"), q, 700).select("query_id", "doc_id", "score").collect()))


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "doc_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert lsh.nearest(lsh.LshIndex.build(none), one, 3).count() == 0
    index = lsh.LshIndex.build(spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<float>"))
    assert lsh.nearest(index, one.limit(0), 3).count() == 0 and lsh.nearest(index, one, 3, probe_bits=0).count() == 1


def test_vectors_of_many_query_blocks_are_not_shuffled(spark, monkeypatch):
    x = clustered(6000, 16, 50)
    v, q = table(spark, x), table(spark, x[:300]).withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, vectors.nearest(v, q, 5).select("query_id", "rank", "doc_id", "score").collect()))
    blocks = vectors.nearest(v, q, 5, max_bytes=8192)
    assert sorted(map(tuple, blocks.select("query_id", "rank", "doc_id", "score").collect())) == want
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Generate" not in plan
    seen = []  # a task holds about max_bytes of vectors while it reads the blocks
    scan = vectors._scan
    monkeypatch.setattr(vectors, "_scan", lambda part, mat, k: seen.append(sum(m.nbytes for _, m in part)) or scan(part, mat, k))
    batch = __import__("pyarrow").Table.from_pandas(v.limit(6000).toPandas(), preserve_index=False)

    class One:  # run the task's function here, on one batch
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return list(run(iter(batch.to_batches())))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    vectors._block_scan(One(), q.select("query_id", q.embedding.alias("_v")), "doc_id", 5, schema, 5, 1 << 16)
    assert seen and max(seen) <= (1 << 16) + 4096 * 16 * 8
