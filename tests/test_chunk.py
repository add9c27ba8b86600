import random
import re

import pytest

from shelfspark.config import ChunkConfig
from shelfspark.operators.chunk import STRATEGIES, chunk, strategy_stats


def even(n, size, step):
    out, a = [], 0
    while a < n:
        b = min(a + size, n)
        out.append((a, b))
        if b == n:
            break
        a += step
    return out


def sentences(text, cfg):
    parts = re.split(r"(?<=[.!?…])\s+", text)
    if len(parts) <= 1:
        parts = re.split(r"[,;\n]+", text)
    out, run, start, pos = [], 0, 0, 0
    for k in (len(p.split()) for p in parts):
        if not k:
            continue
        if run + k > cfg.size and run >= cfg.min_size:
            out.append((start, pos))
            start, run = max(0, pos - k), k
        else:
            run += k
        pos += k
    return out + ([(start, pos)] if pos > start else [])


def expected(doc_id, text, strategy, cfg):
    text = re.sub(r"\s+", " ", text).strip()
    w = text.split()
    if len(w) < cfg.min_size:
        return []
    sp = {"fixed_size": lambda: even(len(w), cfg.size, cfg.size - cfg.overlap),
          "sliding_window": lambda: even(len(w), cfg.size, cfg.stride), "sentence_aware": lambda: sentences(text, cfg)}[strategy]()
    return [(f"{doc_id}_chunk_{i}", " ".join(w[a:b]), a, b) for i, (a, b) in enumerate(sp) if b - a >= cfg.min_size]


def corpus():
    rng = random.Random(5)
    docs = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 29, 30, 199, 200, 201, 230, 350, 351, 1000)]
    for _ in range(25):
        docs.append(" ".join(rng.choice(["alpha", "beta.", "gamma!", "delta,", "eps…", "a,b", "zeta\n"]) for _ in range(rng.randint(20, 900))))
    docs.append(", ".join(["one two three"] * 200))
    docs.append(" ".join(["long"] * 400) + ". short end. " + " ".join(["x"] * 35))
    return docs


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("cfg", [ChunkConfig(), ChunkConfig(50, 10, 20, 5)])
def test_chunks_equal_plain_loop(spark, strategy, cfg):
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = sorted((r["chunk_id"], r["text"], r["start_word"], r["end_word"]) for r in chunk(df, strategy, cfg).collect())
    assert got == sorted(x for i, t in enumerate(docs) for x in expected(i, t, strategy, cfg))


def test_chunking_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for s in STRATEGIES:
        assert "Exchange" not in chunk(df, s)._jdf.queryExecution().executedPlan().toString()


def test_even_chunks_cover_every_word(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(777)))], "doc_id long, text string")
    for s in ("fixed_size", "sliding_window"):
        covered = {w for r in chunk(df, s).collect() for w in r["text"].split()}
        assert len(covered) == 777


def test_strategy_stats(spark):
    docs = corpus()
    got = {r["strategy"]: r for r in strategy_stats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    for s in STRATEGIES:
        per = [[b - a for _, _, a, b in expected(i, t, s, ChunkConfig())] for i, t in enumerate(docs)]
        per = [p for p in per if p]
        assert got[s]["n_chunks"] == sum(map(len, per)) and got[s]["total_words"] == sum(map(sum, per))
        assert got[s]["avg_words"] == pytest.approx(sum(round(sum(p) / len(p), 1) for p in per) / len(per), abs=0.06)


def test_bad_parameters():
    with pytest.raises(ValueError):
        ChunkConfig(size=10, overlap=10)
