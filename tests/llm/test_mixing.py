import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from shelfspark.llm.mixing import mix, plan_mix


def targets(sizes):
    """Shares by weight, the excess over three times a source shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = Fraction(3 * sizes[s])
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


def docs_of(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, copies string").repartition(partitions)


def check(spark, rows, **options):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    want = targets(sizes)
    got = plan_mix(docs_of(spark, rows), **options).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, s, t in rows)
    taken = defaultdict(int)
    for r in got:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else Fraction(0)
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) <= 1e-9 * max(1, r.target)
        assert r.taken == r.copies * r.size <= 3 * r.size and abs(r.copies - rate) < 1 + 1e-6
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s] + 1
    again = plan_mix(docs_of(spark, rows, 5), **options)
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in got)
    return got, want, sizes


def test_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "B", "é", "z", None, ""]), "w " * rng.randrange(60)) for i in range(500)]
    rows += [(1000 + i, "hot", " ".join("xy" for _ in range(rng.randrange(1, 9)))) for i in range(700)]
    check(spark, rows)
    got, want, sizes = check(spark, rows, seed="other")
    assert len({r.copies for r in got}) > 1


def test_small_sources_reach_their_cap(spark):
    rows = [(i, "a", "w " * 100) for i in range(50)] + [(100, "b", "x y z"), (101, "c", "x y"), (102, "d", None), (103, "e", "")]
    got, want, sizes = check(spark, rows)
    assert want["b"] == 9 and want["c"] == 6 and {r.doc_id: r.taken for r in got if r.source in "bcde"} == {100: 9, 101: 6, 102: 0, 103: 0}


def test_odd_rows(spark):
    same = [(7, "a", "one two")] * 40
    check(spark, same + [(None, "a", "x"), (None, None, None), (8, None, "q " * 100_000), (9, "a", " "), (10, "a", " \t\n")])
    assert plan_mix(docs_of(spark, same).limit(0)).count() == 0
    check(spark, [(1, "a", None), (2, None, "")])


def test_documents_are_emitted_with_their_columns(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 9)) for i in range(60)]
    copies = Counter({(r.doc_id, r.source): r.copies for r in plan_mix(docs_of(spark, rows)).collect()})
    out = mix(docs_of(spark, rows).withColumnRenamed("size", "copy"))
    assert out.columns == ["doc_id", "source", "text", "copies", "copy"]
    emitted = Counter()
    texts = {i: t for i, _, t in rows}
    for r in out.collect():
        emitted[(r.doc_id, r.source)] += 1
        assert r.text == texts[r.doc_id] and 1 <= r.copy <= copies[(r.doc_id, r.source)]
    assert emitted == +copies
