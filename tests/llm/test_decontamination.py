import math
import random
import re
from collections import Counter

import numpy as np

from shelfspark.llm.decontamination import _CUTS, BITS, BLOCK_RADIUS, RADIUS, Benchmark, drop_contaminated, find_contamination
from tests.llm.helpers import TEXT_EDGES, documents, sentence, vocabulary


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def runs(w, k):
    return [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]


def brute(docs, items):
    bench = {i: words(t) for i, t in items if words(t)}
    spread = Counter(g for w in bench.values() for g in set(runs(w, min(5, len(w)))))
    weight = lambda g: 1 + math.log(len(bench) / spread[g]) if g in spread else 1 + math.log(len(bench))
    out = []
    for d, t in docs:
        w = words(t)
        for i, iw in bench.items():
            a, best = Counter(runs(iw, min(5, len(iw)))), None
            for at in range(len(w) - len(iw) + 1):
                b = Counter(runs(w[at:at + len(iw)], min(5, len(iw))))
                both = sum(min(n, b[g]) * weight(g) for g, n in a.items())
                s = both / (sum(n * weight(g) for g, n in a.items()) + sum(n * weight(g) for g, n in b.items()) - both)
                if s >= .8 - 1e-12 and (best is None or s > best[0] + 1e-12):
                    best = (s, at)
            if best:
                out.append((d, i, round(best[0], 6), best[1]))
    return sorted(out, key=str)


def corpus():
    rng, voc = random.Random(5), vocabulary(400)
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([3, 5, 12, 13, 30, 40])))) for i in range(20)] + [(30, None), (31, ""), (32, "a a a a a a a")]
    docs = []
    for i in range(100):
        w = [rng.choice(voc) for _ in range(rng.randrange(120))]
        if rng.random() < .7:
            v = items[rng.randrange(20)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = "q"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in v]
        docs.append((i, " ".join(w)))
    return docs + [(5, docs[5][1]), (None, items[3][1])] + [(i, t) for i, t in TEXT_EDGES if i != 9005], items


def test_equals_brute_force_and_slices(spark):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = find_contamination(documents(spark, docs), bench)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 40
    kept = drop_contaminated(documents(spark, docs), bench)
    gone = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in gone)
    assert kept.columns == documents(spark, docs).columns
    sliced = find_contamination(documents(spark, docs), bench, slice_chars=600)
    assert sorted(map(tuple, sliced.collect()), key=str) == want


def test_empty_tables(spark):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert find_contamination(documents(spark, docs).limit(0), bench).count() == 0
    assert find_contamination(documents(spark, docs), bench.limit(0)).count() == 0


def bits_of(bench, items):
    return np.unpackbits(bench.prints[items].view(np.uint8), axis=1).astype(bool)


def test_blocks_find_all_prints_within_the_radius():
    rng = random.Random(2)
    bench = Benchmark([(i, sentence(rng, vocabulary(300), 20, 21)) for i in range(30)])
    for k in range(200):
        item = rng.randrange(30)
        bits = bits_of(bench, [item])
        bits[0, rng.sample(range(BITS), RADIUS)] ^= True
        assert item in bench.near(0, bits)[:, 1]
    # The worst case: every block differs in as many bits as it may.
    bits = bits_of(bench, [4])
    for b, (lo, hi) in enumerate(zip(_CUTS[:-1], _CUTS[1:])):
        bits[0, rng.sample(range(lo, hi), BLOCK_RADIUS + (b > 0))] ^= True
    assert [0, 4] in bench.near(0, bits).tolist()


def test_index_prunes_and_stays_small_with_many_items():
    rng, voc = random.Random(4), vocabulary(20_000)
    bench = Benchmark([(i, " ".join(rng.choices(voc, k=20 + i % 2))) for i in range(100_000)])
    assert sum(x.nbytes for x in (*bench.keys, *bench.items, *bench.maps, bench.prints)) < 100 << 20
    bits = np.random.default_rng(1).random((200, BITS)) < .5
    pairs = bench.candidates(1, bits)
    print("candidates per window:", len(pairs) / 200, "of 50000")
    assert len(pairs) / 200 < .0505 * 50_000 and all(bench.length_of[i] == 1 for i in pairs[:500, 1])
    # The blocks bring together what a comparison with all prints finds.
    probe = bits_of(bench, np.arange(1, 41, 2))
    probe ^= np.random.default_rng(2).random(probe.shape) < .19
    prints = np.packbits(probe, axis=1).view(np.uint64)
    far = np.bitwise_count(prints[:, None] ^ bench.prints[None, 1::2]).sum(axis=2)
    want = sorted((int(w), 2 * int(i) + 1) for w, i in np.argwhere(far <= RADIUS))
    assert sorted(map(tuple, bench.near(1, probe).tolist())) == want and len(want) > 10


def test_very_long_text_with_scattered_copies(spark):
    rng, voc = random.Random(7), vocabulary(3_000)
    items = [(i, " ".join(rng.choices(voc, k=25 + i % 3))) for i in range(12)]
    long = " ".join(" ".join(rng.choices(voc, k=5_000)) + " " + t for _, t in items)
    again = " ".join([items[0][1]] * 1_500)
    got = find_contamination(documents(spark, [(1, long), (2, again)]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(1, i, 1.0) for i, _ in items} | {(2, 0, 1.0)}
    assert {r.item_id: r.first_word for r in got if r.doc_id == 1} == {i: sum(5_000 + len(t.split()) for _, t in items[:i]) + 5_000 for i, _ in items}


def test_documents_shorter_than_the_item(spark):
    rng, voc = random.Random(9), vocabulary(300)
    items = [(i, " ".join(rng.choice(voc) for _ in range(n))) for i, n in enumerate([20, 20, 30, 40, 9, 6, 3])]
    docs = []
    for i, t in items:
        w = t.split()
        docs += [(100 * i + 10 * a + b, " ".join(w[a:len(w) - b])) for a in range(5) for b in range(5)]
    bench, whole = dict(items), {}
    spread = Counter(g for _, t in items for g in set(runs(words(t), min(5, len(words(t))))))
    weight = lambda g: 1 + math.log(len(items) / spread.get(g, 1))
    for d, t in docs:
        for i in bench:
            k = min(5, len(words(bench[i])))
            a, b = Counter(runs(words(bench[i]), k)), Counter(runs(words(t), k))
            if len(words(t)) <= len(words(bench[i])):
                both = sum(n * weight(g) for g, n in (a & b).items())
                s = both / sum(n * weight(g) for g, n in (a | b).items())
                if s >= .8 - 1e-12:
                    whole[d, i] = round(s, 6)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("pairs found:", len(set(got) & set(whole)), "of", len(whole))
    assert got == whole and len(whole) > 30
    kept = drop_contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in whole}


def test_slices_give_equal_results(spark):
    rng, voc = random.Random(12), vocabulary(300)
    stock = [[rng.choice(voc) for _ in range(9)] for _ in range(6)]  # shared by many items
    items = [(i, " ".join(rng.choice(stock) + [rng.choice(voc) for _ in range(12)] + rng.choice(stock))) for i in range(40)]
    docs = []
    for d in range(240):
        v = items[d % 40][1].split()
        for _ in range(rng.choice([0, 1])):
            v[rng.randrange(len(v))] = "q"
        if rng.random() < .4:  # the end becomes a passage of other items
            v[-9:] = rng.choice(stock)
        docs.append((d, " ".join([rng.choice(voc) for _ in range(6)] + v)))
    bench, table = spark.createDataFrame(items, "item_id long, text string"), documents(spark, docs)
    want = sorted(map(tuple, find_contamination(table, bench).collect()))
    for chars in (600, 2_000):
        got = sorted(map(tuple, find_contamination(table, bench, slice_chars=chars).collect()))
        print("rows equal with", chars, "characters:", len(set(want) & set(got)), "of", len(want), "and", len(set(got) - set(want)), "others")
        assert got == want and len(want) > 60
    kept = {r.doc_id for r in drop_contaminated(table, bench, slice_chars=2_000).collect()}
    assert kept == {d for d, _ in docs} - {w[0] for w in want}
