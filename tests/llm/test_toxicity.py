import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.llm.toxicity import ToxicModel, drop_toxic, fit, maximal_segments, score_documents, tokens
from tests.llm.helpers import TEXT_EDGES, documents, sentence, vocabulary

BAD = ["vexgrim", "snarlux", "blightor", "grumsk", "maldurn"]


def corpus(n=400, seed=4):
    rng, voc = random.Random(seed), vocabulary(400)
    voc = ["".join(chr(97 + int(c)) for c in w[1:]) + "o" for w in voc]
    rows, labels = [], []
    for i in range(n):
        w, toxic = sentence(rng, voc, 30, 120).split(), int(rng.random() < .3)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (a, b, total)
    if best is None:
        return []
    a, b, total = best
    right = [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(scores[b + 1:])]
    return brute_segments(scores[:a]) + [(a, b, total)] + right


def test_segments_equal_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 25)
        at = sorted(rng.sample(range(n), rng.randrange(n + 1)))
        gain = [rng.randrange(1, 60) / 7.3 for _ in at]
        scores = [-0.9] * n
        for i, g in zip(at, gain):
            scores[i] = g
        got = maximal_segments(at, gain, 0.9)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_scan_is_linear():
    n = 200_000
    assert len(maximal_segments(list(range(0, 2 * n, 2)), [1.0] * n, 1.5)) == n


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_rows(spark, model):
    rows, labels = corpus()
    edges = TEXT_EDGES + [(None, "vexgrim snarlux"), (3, rows[3][1])]
    got = score_documents(documents(spark, rows + edges), model).collect()
    assert len(got) == len(rows) + len(edges)
    truth = dict(labels)
    out = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for _, y, p in out) >= 0.95 * len(out)
    assert all(r.held_out == held(r.doc_id) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (9001, 9002, 9003))


def test_passages_hold_the_words(spark, model):
    quiet = "ao bo co do eo fo " * 10
    text = quiet + "vexgrim snarlux blightor " + quiet
    (row,) = score_documents(documents(spark, [(1, text)]), model).collect()
    assert row.n_passages == 1 and tokens(text)[row.passages[0]["first"]:row.passages[0]["last"] + 1] == ["vexgrim", "snarlux", "blightor"]
    kept = drop_toxic(documents(spark, [(1, text), (2, quiet), (3, None)]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and "spans" in kept.columns


def test_held_out_labels_are_not_read(spark, model):
    rows, labels = corpus()
    turned = [(i, 1 - y if held(i) else y) for i, y in labels]
    assert fit(documents(spark, rows), spark.createDataFrame(turned, "doc_id long, toxic int")) == model


@pytest.mark.parametrize("label,score", [(None, 0), (1, 1), (0, 0)])
def test_without_two_classes(spark, label, score):
    labels = spark.createDataFrame([(i, label) for i in range(9)], "doc_id long, toxic int")
    m = fit(documents(spark, [(i, "a") for i in range(9)]), labels)
    assert {r.predicted for r in score_documents(documents(spark, [(1, "a"), (2, None)]), m).collect()} == {score}
    assert score_documents(documents(spark, [(1, "a")]).limit(0), ToxicModel()).count() == 0
    assert labels.filter(F.col("toxic").isNull()).count() in (0, 9)


def test_sampling_a_class_keeps_the_prior(spark):
    rng = random.Random(8)
    voc = ["".join(chr(97 + int(c)) for c in w[1:]) + "o" for w in vocabulary(400)]
    rows, labels = [], []
    for i in range(2400):  # one toxic row in twelve; the marks also stand in clean rows
        w, toxic = sentence(rng, voc, 20, 60).split(), int(i % 12 == 0)
        for _ in range(2 if toxic else int(rng.random() < .25)):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs, marks = documents(spark, rows).cache(), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, capped = fit(docs, marks), fit(docs, marks, per_class=170)
    a, b = ({r.doc_id: r for r in score_documents(docs, m).collect()} for m in (whole, capped))
    total = [sum(r.score for r in x.values()) / 2400 for x in (a, b)]
    differ = sum(a[i].predicted != b[i].predicted for i in a)
    print("mean score:", total, "decisions that differ:", differ)
    assert abs(total[0] - 1 / 12) < .02 and abs(total[1] - total[0]) < .03
    assert differ <= 0.05 * len(a)  # the capped fit reads a tenth of the clean rows


def test_the_same_passage_counts_alike_everywhere(spark, model):
    quiet, passage = "ao bo co do eo fo " * 200, "vexgrim snarlux blightor grumsk maldurn "
    scattered = "".join(quiet + w + " " for w in BAD * 3)
    texts = [(1, quiet + (passage + quiet) * 3), (2, passage + scattered + quiet), (3, scattered + quiet + passage)]
    got = {r.doc_id: r.passages for r in score_documents(documents(spark, texts), model).collect()}
    whole = {i: [p["score"] for p in ps if p["last"] - p["first"] == 4] for i, ps in got.items()}
    print("whole passages found:", {i: len(s) for i, s in sorted(whole.items())})
    assert [len(whole[i]) for i in (1, 2, 3)] == [3, 1, 1]
    assert max(sum(whole.values(), [])) - min(sum(whole.values(), [])) < 1e-6


def test_words_of_clean_texts_cost_their_log_odds(spark):
    rows = [(i, ("vexgrim snarlux " * 3 if i % 3 == 0 else "harmless " * 3) + ["ao bo ", "co do "][i % 2] * 4) for i in range(300)]
    m = fit(documents(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert m.gain("vexgrim") > 0 > -m.drift > m.gain("harmless") and m.gain("unseen") == 0


def test_a_measured_word_keeps_its_own_log_odds(spark):
    """A word of clean texts that begins like a toxic one does not score as toxic; an unseen inflection does."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{rng.randrange(300)}x" for _ in range(40)] + (["grumbler", "grumbled", "grumbling"] if toxic else ["grumbine"] * (i % 2))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.gain("grumbler") > 1 and model.gain("grumbles") > 1 and model.gain("grumbine") <= 0


def test_the_sample_is_written_once(spark, monkeypatch):
    from shelfspark.llm import toxicity
    written, write = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: written.append(name) or write(df, name))
    docs = spark.createDataFrame([(i, "aa bb" if i % 2 else "cc dd") for i in range(40)], "doc_id long, text string")
    fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert written == ["labelled", "tokens"]
