import random
import re
from collections import defaultdict

import numpy as np
import pytest

from shelfspark.llm.common import mix64
from shelfspark.llm.components import connected_components
from shelfspark.llm.jaccard_join import jaccard_join, keep_one, least_matches, shingles, signature
from tests.llm.helpers import documents, vocabulary


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else None)
    n, near = len(rows), defaultdict(set)
    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        same = [rows[x][0] for x in range(n) if sets[x] == sets[a] and rows[x][0] is not None] if sets[a] else [rows[a][0]]
        out.append((rows[a][0], min(ids) if sets[a] and ids else rows[a][0], min(same) if same else None, len(near[a]), len({sets[x] for x in near[a] if sets[x] != sets[a]})))
    return sorted(out, key=str)


def corpus():
    rng, voc = random.Random(5), vocabulary(300)
    rows = []
    for i in range(100):
        w = [rng.choice(voc) for _ in range(rng.randrange(1, 90))]
        rows.append((len(rows) + 10, "  ".join(w)))
        for _ in range(rng.choice([0, 0, 1, 5, 30 if i == 5 else 2])):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = rng.choice(voc)
            rows.append((len(rows) + 10, " ".join(v).upper() if rng.random() < .2 else " ".join(v)))
    return rows + [(5000, None), (5001, ""), (5002, "!!"), (5003, "!!"), (11, rows[3][1]), (11, rows[3][1]), (None, rows[4][1]), (5004, "a b c"), (5005, "A  b c"),
                   (5006, "z " * 30_000), (5007, "z " * 20_000)]


@pytest.mark.parametrize("block", [512, 4])
def test_equals_brute_force(spark, block):
    rows = corpus()
    assert sorted([tuple(r)[:5] for r in jaccard_join(documents(spark, rows), block=block).collect()], key=str) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    kept = keep_one(documents(spark, rows))
    want = {(i, t) for (i, t), x in zip(sorted(rows, key=str), sorted(brute(rows), key=str)) if x[0] == x[1] and i == x[0]}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) == len({(i, t) for i, t in got}) and {i for i, _ in want} == {i for i, _ in got}
    assert kept.columns == documents(spark, rows).columns
    assert keep_one(documents(spark, rows).limit(0)).count() == 0


def test_pruning_keeps_similar_pairs():
    least = least_matches()
    assert all(m < .8 * n for n, m in least.items()) and least[128] > 64
    rng, voc = random.Random(1), vocabulary(3000)
    lost = 0
    for _ in range(200):
        w = [rng.choice(voc) for _ in range(400)]
        v = list(w)
        for at in rng.sample(range(400), 7):
            v[at] = "x"
        a, b = signature(shingles(" ".join(w))), signature(shingles(" ".join(v)))
        lost += any(int((a[:n] == b[:n]).sum()) < m for n, m in least.items())
    assert lost == 0


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1001), (5, 5), (1001, 1002)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64))
    b = np.r_[a[:1500], mix64(np.arange(1, 501, dtype=np.uint64))]
    assert abs((signature(a) == signature(np.unique(b))).mean() - 0.6) < 0.15
