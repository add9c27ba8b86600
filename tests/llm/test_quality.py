import random
import zlib

import numpy as np
import pytest
import xxhash

from shelfspark.llm.quality import BUCKETS, GRAM_BUCKETS, WORD_BUCKETS, QualityModel, features, fit, score_documents, shares
from tests.llm.helpers import TEXT_EDGES, documents, sentence, vocabulary


def corpus(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        t, good = sentence(rng, vocabulary(400), 20, 80), int(rng.random() < .7)
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join([t.split()[0]] * 50), t.replace(" ", " | ")])
        rows.append((i, t))
        labels.append((i, good))
    return rows, labels


def test_held_out_rows_and_edges(spark):
    rows, labels = corpus()
    df, lab = documents(spark, rows + TEXT_EDGES + [(None, "x y"), (1, rows[1][1])]), spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit(df, lab)
    got, truth = score_documents(df, model).collect(), dict(labels)
    assert len(got) == len(rows) + len(TEXT_EDGES) + 2
    out = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in got)
    again = fit(df, lab)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


@pytest.mark.parametrize("label,score", [(None, 0), (1, 1), (0, 0)])
def test_without_two_classes(spark, label, score):
    m = fit(documents(spark, [(i, "a") for i in range(9)]), spark.createDataFrame([(i, label) for i in range(9)], "doc_id long, quality int"))
    assert {r.predicted for r in score_documents(documents(spark, [(1, "a"), (2, None)]), m).collect()} == {score}
    assert score_documents(documents(spark, [(1, "a")]).limit(0), m).count() == 0


def test_features():
    words, grams, patterns = features("ab ab cd")
    assert len(words) == 3 and words[0] == words[1] and len(grams) == 6 + 5 and len(set(patterns.tolist())) == 2
    index, share = shares("ab ab cd")
    assert abs(share.sum() - 1) < 1e-6 and index.max() < BUCKETS
    assert QualityModel(np.zeros(BUCKETS), 0.0).score("") == 0.5


def plain_score(text, model):
    """The score from the definition, one word and one run of characters at a time."""
    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2 ** 64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2 ** 64
        return x ^ x >> 31
    words, kinds, last = text.split(), ([], [], []), {}
    for place, w in enumerate(words):
        kinds[0].append(xxhash.xxh3_64_intdigest(w) % WORD_BUCKETS)
        back = place - last[w] if w in last else -1
        kinds[2].append(WORD_BUCKETS + GRAM_BUCKETS + (0 if back < 0 else 1 if back <= 1 else 2 if back <= 8 else 3 if back <= 64 else 4))
        last[w] = place
    for k in (3, 4):
        for i in range(len(text) - k + 1):
            acc = ord(text[i]) + k
            for c in text[i + 1:i + k]:
                acc = (acc * 0x100000001B3 + ord(c)) % 2 ** 64
            kinds[1].append(WORD_BUCKETS + mixed(acc) % GRAM_BUCKETS)
    z = model.bias + sum(sum(model.weights[i] for i in kind) / len(kind) for kind in kinds if kind) / 3
    return 1 / (1 + np.exp(-min(max(z, -30), 30)))


def test_scores_equal_brute_force(spark):
    rows, labels = corpus(120)
    rows += [(500 + i, t) for i, t in enumerate(["", "a", "ab", "é ü 😀 é", "x\u00a0y\tz", " one  one one ", "q " * 90 + "r " + "q"])] + [(600, None)]
    df = documents(spark, rows)
    model = fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in score_documents(df, model).collect()}
    assert len(got) == len(rows) and all(abs(got[i] - plain_score(t or "", model)) < 1e-9 for i, t in rows)


def test_pieces_equal_the_whole_text():
    rng = random.Random(6)
    text = "".join(rng.choice(["ab ", "c ", "dd\n", "é", "😀 ", " "]) for _ in range(900)) + "w" * 200 + " end ab"
    for piece in (1, 7, 64, 500):
        for a, b in zip(features(text, piece), features(text)):
            assert sorted(a.tolist()) == sorted(b.tolist())
        assert all(np.allclose(a, b) for a, b in zip(shares(text, piece), shares(text)))


def test_memory_of_a_very_long_text():
    import tracemalloc
    text = ("some words of a very long text " * 40_000)[:1_200_000] * 6  # 7 MB
    model = QualityModel(np.linspace(-1, 1, BUCKETS), 0.1)
    tracemalloc.start()
    model.score(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
