import hashlib
import random
import re

import pytest

from shelfspark.llm.substring_dedup import remove_repeats
from tests.llm.helpers import documents, sentence, vocabulary


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [i if i is not None else 1 << 62 for i, _ in rows]
    first = {}
    for x, w in zip(ids, words):
        for j in range(len(w) - 12):
            g = tuple(w[j:j + 13])
            first[g] = min(first.get(g, 1 << 62), x)
    out = []
    for (i, _), x, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < x:
                gone[j:j + 13] = [True] * 13
        kept = [a for a, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [["a", "b", "é", "c\x0b"], vocabulary(300)])
def test_equals_brute_force(spark, words):
    rng = random.Random(5)
    rows = []
    for i in range(250):
        t = sentence(rng, words, 0, 90)
        if rows and rng.random() < .5:
            p = rng.choice(rows)[1].split()
            a = rng.randrange(len(p) + 1)
            t += " \n" + " ".join(p[a:a + rng.randrange(5, 40)]) + "\t x y " + t[:20]
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (1002, "a " * 3000), (1003, "a " * 3000), (7, rows[8][1]), (7, rows[7][1]), (None, rows[3][1])]
    got = remove_repeats(documents(spark, rows))
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute(rows)


def test_passage_shared_by_all_and_filter_size(spark):
    rng = random.Random(1)
    shared = sentence(rng, vocabulary(500), 60, 61)
    rows = [(i, f"{sentence(rng, vocabulary(5000), 20, 30)} {shared} {i}") for i in range(200)]
    want = brute(rows)
    for bits in (1 << 27, 1 << 6):  # a full filter lets everything through and changes nothing
        assert sorted([tuple(r)[:4] for r in remove_repeats(documents(spark, rows), filter_bits=bits).collect()], key=str) == want


def test_kept_text_and_empty_table(spark):
    p = " ".join(f"p{k}" for k in range(20))
    got = {r.doc_id: r.kept for r in remove_repeats(documents(spark, [(1, p), (2, f"x {p}\ty")])).collect()}
    assert got == {1: p, 2: "x y"}
    assert remove_repeats(documents(spark, [(1, p)]).limit(0)).count() == 0
