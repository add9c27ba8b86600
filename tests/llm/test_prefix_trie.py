import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfspark.llm.prefix_trie import prefix_trie, rebuilt_trie


def sequences(rows):
    """The turns of every conversation in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in out.items()}


def spliced(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = seqs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    n_words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    childless = {node for node in members if len(below[node]) == 1}
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(seqs[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(x) == len(node) + 1 for x in below[node]), sum(x in childless for x in below[node]),
                    sum((len(members[x]) - 1) * n_words(x) for x in below[node]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: r[:2])


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, ends string").repartition(partitions)


def conversations(seed, n, longest, kinds=3):
    """Conversations of few different turns, so that many beginnings and ends are shared."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t * 7, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", "w " * rng.randrange(kinds)))
    return rows


@pytest.mark.parametrize("options", [{}, {"width": 2, "range_rows": 5}, {"width": 3, "range_rows": 17}, {"width": 64, "range_rows": 3}])
def test_equals_brute_force(spark, options):
    rows = conversations(1, 70, 9)
    rows += [(c, t, "user", "same") for c in range(500, 530) for t in range(6)]  # one conversation many times
    rows += [(600, t, "user", f"t {t}") for t in range(40)] + [(620, t, "user", f"t {t}") for t in range(37)]
    t = table(spark, rows)
    assert found(prefix_trie(t, **options)) == brute(sequences(rows))
    assert found(rebuilt_trie(t, **options)) == brute(spliced(sequences(rows)))


@pytest.mark.parametrize("options", [{}, {"width": 2, "range_rows": 4}])
def test_odd_rows(spark, options):
    rows = [(40, None, None, None), (40, 0, "user", "a  b\tc"), (40, 0, "assistant", "z"), (40, 0, "assistant", "b"), (40, 0, "assistant", "b"), (41, 5, "user", "x"), (41, 3, None, ""),
            (None, 1, "user", "lost"), (77, None, "user", "only"), (77, None, "user", "only"), (-3, 1, "user", "neg"), (90, 1, "user", "v " * 200_000), (91, 1, "user", "v " * 200_000)]
    t = table(spark, rows)
    assert found(prefix_trie(t, **options)) == brute(sequences(rows))
    plain = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(rebuilt_trie(table(spark, plain), **options)) == brute(spliced(sequences(plain)))
    doubled = table(spark, plain + plain)
    assert found(rebuilt_trie(doubled, **options)) == brute(spliced(sequences(plain + plain)))


def test_turnless_and_empty(spark):
    lonely = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]  # own turns go, no base
    rows = [(c, 0, "user", "hello") for c in lonely]
    assert found(rebuilt_trie(table(spark, rows))) == brute(spliced(sequences(rows))) == [
        (min(lonely), 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(lonely))).encode()).hexdigest())]
    assert rebuilt_trie(table(spark, rows).limit(0)).count() == 0 and prefix_trie(table(spark, rows).limit(0)).count() == 0


def test_one_long_conversation_is_spread(spark):
    rows = [(0, t, "user", f"t {t % 7}") for t in range(1500)] + [(1, t, "user", f"t {t % 7}") for t in range(900)] + [(5, 0, "user", "x")]
    assert found(prefix_trie(table(spark, rows), range_rows=40)) == brute(sequences(rows))
