"""Toxic passages by maximum-scoring segments of token log-odds.

Fit: token and document counts of both classes over a bounded sample of labelled rows; the
log-odds of every token with an informative Dirichlet prior (its share in both classes
together); the significantly toxic tokens form the lexicon, and the words significant for clean
texts are kept with their negative log-odds. A token is a lower-cased word or the first letters
of one, so that unseen inflections still count; a word that was measured keeps its own log-odds.

Search: every place of a text scores the log-odds of its token, however often and wherever the
token stood before; tokens whose log-odds are not told from zero cost a small constant. A linear
scan returns all maximal scoring segments of a text. Under chance the best segment of a clean text of n tokens follows
an extreme-value law, P(S > x) = 1 - exp(-K n e^(-lambda x)); lambda is the root of the score
distribution of clean texts, K its maximum-likelihood estimate over the clean rows. Segments
that chance does not explain are the toxic passages; the evidence of a document adds theirs
up, and a logistic curve fitted to the same rows turns evidence into a probability. Where a
class is sampled, its rows weigh as many labelled rows as they stand for, so the meaning of a
probability does not change with the number of labelled rows.

Defined results: null and empty texts have no token, no passage and the score of no
evidence; every input row gives one row; a table without labels, or with one class only,
gives the share of that class (0 without any row) to all documents; only the id and text
columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import class_weights, held_out, labelled_sample, materialize

#: Bounds of the fit: labelled rows of either class, tokens of either sign.
SAMPLE_PER_CLASS = 10_000
LEXICON_TOKENS = 20_000
PREFIXES = (4, 5, 6, 7)
#: Weight of the prior in pseudo-documents. A token gains the lower bound of its log-odds (one
#: standard deviation below); tokens that gain less, or are met in fewer documents, are left out.
#: MIN_GAIN is measured: at sf0.1 bounds of 1.5, 0.5 and 0 find 88, 75 and 60 of 97 held-out toxic
#: documents with 1, 3 and 6 false alarms (weak tokens of clean texts add up to segments).
PRIOR_DOCS = 20.0
MIN_GAIN = 1.5
MIN_DOCS = 3
#: Cost of a token without significant log-odds, at least.
DRIFT = 0.02
_FLUSH = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def maximal_segments(at: list[int], gain: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place inclusive, score) of a sequence that
    gains ``gain[i]`` (or loses it, below zero) at place ``at[i]`` and loses ``drift`` at every other one; linear time."""
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    before: list[int] = []  # the nearest earlier candidate with a smaller left sum
    total, last = 0.0, -1
    for place, value in zip(at, gain):
        total -= drift * (place - last - 1)
        if value <= 0:
            total, last = total + value, place
            continue
        lo, hi, first = total, total + value, place
        total, last = hi, place
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = before[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                span.append((first, place))
                before.append(j)
                break
            lo, first = left[j], span[j][0]
            del left[j:], right[j:], span[j:], before[j:]
    return [(a, b, r - lft) for (a, b), lft, r in zip(span, left, right)]


@dataclass
class ToxicModel:
    """What scoring needs; bounded by LEXICON_TOKENS of either sign."""

    gains: dict[str, float] = field(default_factory=dict)
    #: Words measured without a significant gain although they begin like a toxic token.
    neutral: frozenset[str] = frozenset()
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def gain(self, word: str) -> float:
        """The measured value of a word; its beginnings count for words that were not measured only."""
        own = self.gains.get(word)
        if own is not None or word in self.neutral:
            return own or 0.0
        return max(self.gains.get(word[:k] + "*", 0.0) for k in PREFIXES)

    def evidence(self, n: int, score: float) -> float:
        """How far a segment lies beyond what the best of n clean tokens reaches."""
        return self.lam * score - math.log(max(self.k, 1e-12) * max(n, 1))

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(max(self.intercept + self.slope * evidence, -30.0), 30.0)))


class _Gains(dict):
    """Gain of every word seen by a task; emptied when it grows too large."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > _FLUSH:
            self.clear()
        value = self[word] = self.model.gain(word)
        return value


def _segments(text: str, model: ToxicModel, gains: _Gains) -> tuple[int, list[tuple[int, int, float]]]:
    words = tokens(text)
    score = np.fromiter(map(gains.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(score).tolist()
    if not at:
        return len(words), []
    return len(words), maximal_segments(at, score[at].tolist(), model.drift)


def token_counts(sample: DataFrame) -> DataFrame:
    """token, toxic and clean documents with it, its places in clean ones."""
    def count(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.table({"token": [k[0] for k in seen], "kind": pa.array([k[1] for k in seen], pa.int32()),
                            "n": pa.array(list(seen.values()), pa.int64())}).to_batches()
            seen.clear()
            return out
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label")):
                places = Counter(tokens(text.as_py()))
                short: Counter = Counter()
                for w, n in places.items():
                    for k in PREFIXES:
                        if len(w) >= k:
                            short[w[:k] + "*"] += n
                label = label.as_py()
                for part in (places, short):
                    seen.update((w, label) for w in part)
                    if label == 0:
                        for w, n in part.items():
                            seen[w, 2] += n
                if len(seen) > _FLUSH:
                    yield from flush()
        yield from flush()
    one = lambda v: F.sum(F.when(F.col("kind") == v, F.col("n")).otherwise(0))
    return (sample.select("text", "label").mapInArrow(count, "token string, kind int, n long")
            .groupBy("token").agg(one(1).alias("toxic"), one(0).alias("clean"), one(2).alias("places")))


def _root(rates: np.ndarray, gains: np.ndarray, drift: float) -> float:
    """The positive solution of E[exp(lambda s)] = 1 over clean tokens."""
    rest = max(1.0 - float(rates.sum()), 0.0)
    value = lambda lam: float((rates * np.exp(lam * gains)).sum()) + rest * math.exp(-lam * drift) - 1.0
    lo, hi = 0.0, 1e-3
    while value(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak ridge."""
    a = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - 1e-2 * beta
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> ToxicModel:
    sample = materialize(labelled_sample(docs, labels, label, per_class).select("text", "label"), "labelled")
    size = {r["label"]: (r["n"]) for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return ToxicModel(intercept=30.0 if n1 else -30.0)
    # A class of more rows than the bound is sampled: its rows stand for so many labelled ones.
    stands = class_weights(labels, label, per_class)
    w1, w0 = stands[1], stands[0]
    share = (F.col("toxic") * w1 + F.col("clean") * w0) / float(n1 * w1 + n0 * w0)
    a1 = F.col("toxic") + share * PRIOR_DOCS
    a0 = F.col("clean") + share * PRIOR_DOCS
    # A token of every document has no odds; both classes then get the same ones.
    without = lambda a, n: F.greatest(n + PRIOR_DOCS - a, F.lit(1e-9 * (n + PRIOR_DOCS)))
    odds = F.log(a1 / without(a1, n1)) - F.log(a0 / without(a0, n0))
    gain = odds - F.sqrt(1 / a1 + 1 / a0)
    all_tokens = materialize(token_counts(sample).filter(F.col("toxic") + F.col("clean") >= MIN_DOCS), "tokens")
    lexicon = (all_tokens.filter(F.col("toxic") >= MIN_DOCS).withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN)
               .orderBy(F.desc("gain"), "token").limit(LEXICON_TOKENS).collect())
    # Words that tell of clean texts lose the upper bound of their log-odds.
    loss = odds + F.sqrt(1 / a1 + 1 / a0)
    against = (all_tokens.filter((F.col("clean") >= MIN_DOCS) & ~F.col("token").endswith("*")).withColumn("gain", loss).filter(F.col("gain") < 0)
               .orderBy("gain", "token").limit(LEXICON_TOKENS).collect())
    gains = {r["token"]: float(r["gain"]) for r in [*lexicon, *against]}
    begun = F.lit(False)
    for k in PREFIXES:
        short = [t[:-1] for t, g in gains.items() if t.endswith("*") and len(t) == k + 1 and g > 0]
        begun = begun | F.substring("token", 1, k).isin(short) if short else begun
    known = all_tokens.filter(begun & ~F.col("token").endswith("*") & (F.col("toxic") + F.col("clean") >= MIN_DOCS)).select("token")
    model = ToxicModel(gains=gains, neutral=frozenset(r["token"] for r in known.collect() if r["token"] not in gains))  # words of the sample

    # Clean tokens: how often each gain is met there; unseen lexicon tokens count half a place.
    places = _clean_places(sample.filter("label = 0"), model)
    total = max(sum(places.values()), 1)
    hit = [(g, n) for g, n in places.items() if g]
    if not any(g > 0 for g, _ in hit):
        hit.append((max(gains.values(), default=1.0), 0.5))
    g, rate = np.array([x for x, _ in hit]), np.array([n for _, n in hit]) / total
    model.drift = max(DRIFT, 1.5 * float((np.maximum(g, 0) * rate).sum()))
    model.lam = _root(rate, g, model.drift)

    best = _best_segments(sample.select("text", "label"), model)
    model.k = 1.0
    raw = best.withColumn("chance", F.greatest("n", F.lit(1)) * F.exp(-F.lit(model.lam) * F.col("best")))
    clean = raw.filter("label = 0").agg(F.count(F.lit(1)).alias("n"), F.sum("chance").alias("s")).first()
    model.k = float(clean["n"]) / max(float(clean["s"]), 1e-9)
    # The evidence of every row on a grid, with its label: bounded by the number of cells.
    grid = (_evidence(sample.select("text", "label"), model).withColumn("cell", F.round(F.greatest(F.least("evidence", F.lit(60.0)), F.lit(-20.0)) * 4).cast("int"))
            .groupBy("cell", "label").count().collect())
    x = np.array([r["cell"] / 4 for r in grid])
    y = np.array([float(r["label"]) for r in grid])
    model.intercept, model.slope = _logistic(x, y, np.array([r["count"] * stands[r["label"]] for r in grid]))
    return model


def _clean_places(clean: DataFrame, model: ToxicModel) -> dict[float, int]:
    """Places of clean texts by their gain (0: none), gains rounded to a grid."""
    def count(batches):
        gains, seen = _Gains(model), Counter()
        for b in batches:
            for text in b.column("text"):
                words = tokens(text.as_py())
                values, n = np.unique(np.round(np.fromiter(map(gains.__getitem__, words), np.float64, len(words)), 1), return_counts=True)
                for v, k in zip(values.tolist(), n.tolist()):
                    seen[v] += k
        yield pa.RecordBatch.from_pydict({"gain": pa.array(list(seen), pa.float64()), "n": pa.array(list(seen.values()), pa.int64())})
    return {r["gain"]: r["n"] for r in clean.select("text").mapInArrow(count, "gain double, n long").groupBy("gain").agg(F.sum("n").alias("n")).collect()}


def _best_segments(rows: DataFrame, model: ToxicModel) -> DataFrame:
    def best(batches):
        gains = _Gains(model)
        for b in batches:
            found = [_segments(t.as_py(), model, gains) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([max((s[2] for s in seg), default=0.0) for _, seg in found], pa.float64())], ["label", "n", "best"])
    return rows.mapInArrow(best, "label int, n long, best double")


def document_evidence(n: int, segments: list[tuple[int, int, float]], model: ToxicModel) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Evidence of a document and its toxic passages (first, last, score, evidence)."""
    rated = [(*s, model.evidence(n, s[2])) for s in segments]
    passages = [s for s in rated if s[3] > 0]
    if passages:
        return sum(s[3] for s in passages), passages
    return max((s[3] for s in rated), default=model.evidence(n, 0.0)), []


def _evidence(rows: DataFrame, model: ToxicModel) -> DataFrame:
    def run(batches):
        gains = _Gains(model)
        for b in batches:
            e = [document_evidence(*_segments(t.as_py(), model, gains), model)[0] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(e, pa.float64())], ["label", "evidence"])
    return rows.mapInArrow(run, "label int, evidence double")


def score_documents(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and the passages (word places, score)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))

    def run(batches):
        gains = _Gains(model)
        for b in batches:
            found = [document_evidence(*_segments(t.as_py(), model, gains), model) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([model.probability(e) for e, _ in found], pa.float64()),
                 pa.array([[dict(zip(("first", "last", "score", "evidence"), p)) for p in ps] for _, ps in found], passage)], ["doc_id", "score", "passages"])
    out = rows.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<first:bigint,last:bigint,score:double,evidence:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                      F.size("passages").alias("n_passages"), "passages")


def drop_toxic(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    def clean(batches):
        gains = _Gains(model)
        for b in batches:
            keep = [model.probability(document_evidence(*_segments(t.as_py() or "", model, gains), model)[0]) < threshold for t in b.column(text_col)]
            yield b.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(clean, docs.schema)
