import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

from shelfspark.llm.filter_audit import audit, shapley_matrix

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(doc_id, text, first):
    words, out = re.findall(r"[^\x20\x09-\x0D]+", text), set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and first.get(text, doc_id) < doc_id:
        out.add("E")
    return out


def brute(docs, labels):
    first, label, parts, out = {}, defaultdict(lambda: [0, 0]), defaultdict(list), []
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            label[i][0] |= q == 1
            label[i][1] |= x == 1
    for i, s, t in docs:
        parts[s or ""].append((failing(i, t or "", first), *(label[i] if i is not None else (0, 0))))
    for part, rows in parts.items():
        total = defaultdict(int)
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                mine.append([part, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f])
        out += [(*r[:-1], total[r[-1]]) for r in mine]
    return sorted(out)


def tables(spark, docs, labels, partitions=3):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, source string, text string, bits int, part string").repartition(partitions)
    return d, spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, first string")


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for i in range(150):
        words = [rng.choice(["ab", "Cd", "EF", "x#", "ü"] if rng.random() < 0.3 else [f"w{k}" for k in range(60)]) for _ in range(rng.choice([0, 20, 49, 50, 51, 90]))]
        docs.append((i, rng.choice(["a", "b", None, ""]), rng.choice([" ", "\n", "  ", "\x0b"]).join(words)))
    docs += [(200 + i, rng.choice("ab"), docs[rng.randrange(5)][2]) for i in range(60)] + docs[:3]
    docs += [(None, "a", docs[0][2]), (None, None, None), (300, "c", None), (301, "c", ""), (302, "c", "z " * 700_000), (303, "c", " ".join(f"v{k}" for k in range(300_000)))]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert found(audit(*tables(spark, docs, labels))) == brute(docs, labels)


def test_many_copies_and_no_rows(spark):
    docs = [(i, "s", "same text") for i in range(400)] + [(1000, "t", " ".join(f"w{k}" for k in range(60)))]
    d, lab = tables(spark, docs, [(1, 1, 0)])
    assert found(audit(d, lab)) == brute(docs, [(1, 1, 0)])
    assert audit(d.limit(0), lab).count() == 0 and found(audit(d, lab.limit(0))) == brute(docs, [])


def test_shapley_values_are_exact():
    for m in (2, 3, 5):
        for i, row in enumerate(shapley_matrix(m)):
            for s, x in enumerate(row):
                k = s.bit_count()
                want = Fraction(factorial(k - 1) * factorial(m - k), factorial(m)) if s >> i & 1 else -Fraction(factorial(k) * factorial(m - k - 1), factorial(m))
                assert x == want
