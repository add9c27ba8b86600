"""How five filters interact: step counts of every order, and exact Shapley values.

A document is reduced to the set of filters that it fails, one of 32. Per part these sets are
counted, from which follows how many documents every coalition (a set of filters applied
together) removes. Everything else is a difference of coalition removals: a filter applied after
others removes v(others and it) - v(others); what it fails but others removed before is the rest
of v(it); what it alone fails is v(all) - v(all but it).

Shapley values come from the weighted least squares fit of an additive game to v, with the kernel
weights (m - 1) / (C(m, s) s (m - s)) and the efficiency constraint sum(phi) = v(all). Its normal
equations are solved once in rationals (m unknowns), so the values are exact: multiplied by the
number of orders they are whole numbers, the removals summed over all orders.

The first four conditions are those of :func:`failure_bits`; duplicates are found table
wide. Texts meet by their SHA-256; only digests and flags are shuffled. A digest is
joined from the side of the documents, one row per repeated digest on the other, so the rows of
a text with a third of all copies can be split.

Defined results: null texts are empty; an empty source is the null one's equal (part ``''``); a
document without an id is no copy and has no copies after it; rows of the smallest id of a text
are no copies, however often repeated; of several labels of one id 1 wins; missing or null labels
count as not 1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import materialize
from shelfspark.llm.text_stats import SPACES, byte_set, count_marked, count_words, layout
from shelfspark.session import small_side

FILTERS = "ABCDE"
MIN_WORDS = 50
#: 100 * distinct < 65 * words; 100 * capitals > 5 * code points; any of the marks.
DISTINCT_PCT, CAPITALS_PCT = 65, 5
_CAPITAL, _MARK = byte_set(bytes(range(ord("A"), ord("Z") + 1))), byte_set(b"#$%&*|")
#: Bytes of a text whose words are looked at together.
PIECE = 1 << 20


def _n_distinct(text: bytes) -> int:
    """Different words of a text, cut into pieces at spaces."""
    if len(text) <= PIECE:
        return len(set(text.split()))
    seen, at = set(), 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to] not in SPACES:
            to += 1
        seen.update(text[at:to].split())
        at = to
    return len(seen)


def failure_bits(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that every text of a column fails (E needs the whole table)."""
    raw, at = layout(column)
    words = count_words(raw, at)
    chars = count_marked((raw & 0xC0) != 0x80, at)  # bytes that begin a code point
    data = memoryview(raw)
    distinct = np.array([_n_distinct(data[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])], np.int64)
    return ((words < MIN_WORDS) * 1 + (100 * distinct < DISTINCT_PCT * words) * 2 + (100 * count_marked(_CAPITAL[raw], at) > CAPITALS_PCT * chars) * 4
            + (count_marked(_MARK[raw], at) > 0) * 8)


def _with_bits(rows: DataFrame) -> DataFrame:
    """The rows with the column ``bits`` in place of ``text``."""
    keep = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for b in batches:
            bits = pa.array(failure_bits(b.column("text")).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), bits], names=[*(f.name for f in keep), "bits"])
    return rows.mapInArrow(run, T.StructType([*keep, T.StructField("bits", T.IntegerType())]))


def shapley_matrix(m: int) -> list[list[Fraction]]:
    """phi = matrix * v for v over all 2^m coalitions (bit sets): the constrained least squares fit.

    Minimise sum_S k(S) (v(S) - sum_{i in S} phi_i)^2 over the coalitions other than none and all,
    subject to sum(phi) = v(all): the normal equations with one multiplier.
    """
    full = (1 << m) - 1
    kernel = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in range(1, full)}
    size, wide = m + 1, m + 1 + (1 << m)
    rows = [[Fraction(0)] * wide for _ in range(size)]
    for s, k in kernel.items():
        inside = [i for i in range(m) if s >> i & 1]
        for i in inside:
            for j in inside:
                rows[i][j] += k
            rows[i][size + s] += k
            rows[i][size] -= k  # v(S) is measured from v(none)
    for i in range(m):
        rows[i][m] = rows[m][i] = Fraction(1)
    rows[m][size + full], rows[m][size] = Fraction(1), Fraction(-1)
    for c in range(size):  # Gauss-Jordan elimination
        pivot = next(r for r in range(c, size) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        lead = rows[c][c]
        rows[c] = [x / lead for x in rows[c]]
        for r in range(size):
            if r != c and rows[r][c]:
                factor = rows[r][c]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[c])]
    return [row[size:] for row in rows[:m]]


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of FILTERS), good, toxic, n: documents by the filters that they fail."""
    slim = materialize(_with_bits(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text",
                                              F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))), "failures")
    copies = slim.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).filter(F.col("first") < F.col("_last")).drop("_last")
    copies = materialize(copies, "copies")
    known = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = materialize(known.filter("doc_id IS NOT NULL AND good + toxic > 0"), "marked")
    rows = slim.join(small_side(copies, copies.count(), 64), "digest", "left").drop("digest")
    rows = rows.join(small_side(known, known.count(), 48), "doc_id", "left")
    fails = F.col("bits") + F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0)
    return rows.groupBy("part", fails.alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley."""
    m, full = len(FILTERS), (1 << len(FILTERS)) - 1
    sets = failed_sets(docs, labels).withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(full))))
    gone = (F.col("fails").bitwiseAND(F.col("coalition")) != 0).cast("long") * F.col("n")
    removals = sets.groupBy("part", "coalition").agg(F.sum("n").alias("total"), F.sum(gone).alias("all"), F.sum(gone * F.col("good")).alias("good"), F.sum(gone * F.col("toxic")).alias("toxic"))
    held = F.array_sort(F.collect_list(F.struct("coalition", "all", "good", "toxic")))  # all 2^m of them
    v = removals.groupBy("part").agg(F.max("total").alias("total"), held.alias("v"))
    v = v.select("part", "total", *[F.col(f"v.{name}").alias(name) for name in ("all", "good", "toxic")])
    sum_of = lambda columns: sum(columns[1:], columns[0])
    orders = factorial(m)
    whole = [[int(x * orders) for x in row] for row in shapley_matrix(m)]
    shapley = F.array(*[sum_of([F.get("all", F.lit(s)) * F.lit(c).cast("long") for s, c in enumerate(row) if c]) for row in whole])
    v = materialize(v.withColumn("phi", shapley), "coalitions")
    steps = []
    for order in permutations(range(m)):
        before = 0
        for i, f in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[j] for j in order), "step": i + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    kind = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    out = v.select("part", "total", "all", "good", "toxic", "phi", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    at = lambda name, place: F.get(F.col(name), place)
    lost = lambda name: at(name, F.col("after")) - at(name, F.col("before"))
    single = F.element_at(F.array(*[F.lit(1 << i) for i in range(m)]), F.col("f") + 1)
    return out.select(
        "part", "filter_order", "step", (F.col("total") - at("all", F.col("after"))).alias("kept"), lost("all").alias("removed"),
        (at("all", single) - lost("all")).alias("redundant"), (at("all", F.lit(full)) - at("all", F.lit(full) - single)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("phi", F.col("f")).alias("shapley"))
