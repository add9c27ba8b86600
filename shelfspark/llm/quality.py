"""Quality of texts by supervised subword embeddings.

Every word and every run of 3 or 4 characters is hashed to a row of an embedding table, and so
is how far back each word was met before. A document is the average of the means of its word,
character and repetition rows; a softmax layer over that mean gives the classes. Table and
layer are learnt together by stochastic gradient descent in numpy, document by document, from a
bounded sample of labelled rows (whole texts). The sample holds as many rows of either class as
there are, up to the bound; the intercept is then moved to the shares among all labelled rows.

Learning runs in one task on the bounded sample; the model (1 MB) goes to the scan, where the
table and the layer collapse into one number per bucket, so scoring is a sum.

Defined results: null and empty texts have no features and get the score of the intercept;
every input row gives one row; very long texts are read in pieces, of which only sums and the last place of
every different word are kept; without labels, or with one class only, all documents get the
share of that class (0 without any); only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import held_out, labelled_sample, mix64

#: Bound of the sample, and the shape of the model.
SAMPLE_PER_CLASS = 1500
WORD_BUCKETS = 1 << 15
GRAM_BUCKETS = 1 << 15
GRAMS = (3, 4)
#: The last rows of the table belong to the repetition patterns.
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS + 5
DIM = 8
#: Gradient steps, one document each; small samples are gone through more often.
STEPS = 18_000
RATE = 1.0
#: Characters of a text that are looked at together; a longer word is looked at whole.
PIECE = 1 << 20
_WORD, _BLANK = re.compile(r"\S+"), re.compile(r"\s")


class _LastPlaces:
    """Where every word of a text was met last, piece by piece."""

    def __init__(self):
        self.known, self.place, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def patterns(self, words: np.ndarray) -> np.ndarray:
        """For the next words how far back each was met before: never, 1, up to 8, up to 64 words, further."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        back = np.full(n, -1)
        same = words[order[1:]] == words[order[:-1]]
        back[order[1:][same]] = (order[1:] - order[:-1])[same]
        first = order[np.r_[True, ~same][:n]]
        if len(self.known) and n:
            at = np.minimum(np.searchsorted(self.known, words[first]), len(self.known) - 1)
            met = self.known[at] == words[first]
            back[first[met]] = self.n + first[met] - self.place[at[met]]
        last = order[np.r_[~same, True][:n]]
        both, where = np.concatenate([self.known, words[last]]), np.concatenate([self.place, last + self.n])
        keep = np.lexsort((where, both))
        keep = keep[np.r_[both[keep][1:] != both[keep][:-1], True][:len(keep)]]
        self.known, self.place, self.n = both[keep], where[keep], self.n + n
        return np.searchsorted([0, 1, 8, 64], back)


def parts(text: str, piece: int = PIECE):
    """The features of a text in pieces of about ``piece`` characters, cut at blanks."""
    at, last = 0, _LastPlaces()
    while at < len(text) or not at:
        to = len(text)
        if at + piece < to:
            blank = _BLANK.search(text, at + piece)
            to = blank.start() if blank else to
        words = _WORD.findall(text, at, to)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        points = np.frombuffer(text[at:to + max(GRAMS) - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        grams = []
        for k in GRAMS:  # runs that begin in the piece
            n = min(to - at, len(points) - k + 1)
            if n > 0:
                acc = points[:n] + np.uint64(k)
                for j in range(1, k):
                    acc = acc * np.uint64(0x100000001B3) + points[j:n + j]
                grams.append((mix64(acc) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64) + WORD_BUCKETS)
        yield [(h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), np.concatenate(grams) if grams else np.empty(0, np.int64),
               last.patterns(h) + WORD_BUCKETS + GRAM_BUCKETS]
        if to == len(text):
            return
        at = to


def features(text: str, piece: int = PIECE) -> list[np.ndarray]:
    """Buckets of the words, of the character runs and of the repetition patterns of a text."""
    return [np.concatenate(kind) for kind in zip(*parts(text, piece))]


def shares(text: str, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: the three kinds count alike."""
    counts = None
    for part in parts(text, piece):
        own = [np.unique(kind, return_counts=True) for kind in part]
        if counts is None:
            counts = own
        else:  # BUCKETS numbers at most
            for k, (i, n) in enumerate(own):
                all_i, back = np.unique(np.concatenate([counts[k][0], i]), return_inverse=True)
                counts[k] = (all_i, np.bincount(back, np.concatenate([counts[k][1], n])).astype(np.int64))
    index = [i.astype(np.int32) for i, _ in counts]
    share = [(n / max(int(n.sum()), 1) / 3).astype(np.float32) for _, n in counts]
    return np.concatenate(index), np.concatenate(share)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        total, n = np.zeros(3), np.zeros(3)
        for part in parts(text):
            total += [self.weights[f].sum() for f in part]
            n += [len(f) for f in part]
        z = self.bias + float((total[n > 0] / n[n > 0]).sum()) / 3
        return 1.0 / (1.0 + math.exp(-min(max(z, -30.0), 30.0)))


def learn(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, dim: int = DIM, steps: int = STEPS, rate: float = RATE,
          seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding table, softmax weights and biases. ``docs``: buckets and their shares of a document."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    epochs = -(-steps // max(len(docs), 1))
    total, step = max(epochs * len(docs), 1), 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            index, share = docs[d]
            lr = np.float32(rate * (1 - step / total))
            step += 1
            mean = share @ table[index] if len(index) else np.zeros(dim, np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * np.float32(0.1) * p
            if len(index):
                # The mean spreads a step over all rows of the document; the norm of the shares undoes that.
                table[index] -= lr * np.outer(share / np.float32((share ** 2).sum()) * np.float32(0.05), back)
    return table, layer, bias


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("label")).count().filter("label IN (0, 1)")
    size = {r["label"]: r["count"] for r in known.collect()}
    if not size.get(0) or not size.get(1):
        return QualityModel(np.zeros(BUCKETS), 30.0 if size.get(1) else -30.0)

    def count(batches):
        for b in batches:
            index, share = [], []
            for text in b.column("text"):
                i, n = shares(text.as_py())
                index.append(i.tobytes())
                share.append(n.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(index, pa.binary()), pa.array(share, pa.binary())],
                                             ["doc_id", "label", "index", "share"])

    def train(batches):
        rows = sorted(((d, lab, i, s) for b in batches for d, lab, i, s in zip(*[b.column(c).to_pylist() for c in ("doc_id", "label", "index", "share")])),
                      key=lambda r: (r[0], r[2]))
        if rows:
            y = np.array([r[1] for r in rows])
            table, layer, bias = learn([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], y)
            shift = math.log(size[1] / size[0]) - math.log(max(int(y.sum()), 1) / max(int((y == 0).sum()), 1))
            weights = (table @ (layer[:, 1] - layer[:, 0])).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0]) + shift], pa.float64())], ["weights", "bias"])
    sample = labelled_sample(docs, labels, label, per_class)
    kind = sample.schema["doc_id"].dataType.simpleString()
    found = (sample.mapInArrow(count, f"doc_id {kind}, label int, index binary, share binary").repartition(1)
             .mapInArrow(train, "weights binary, bias double").collect())
    if not found:
        return QualityModel(np.zeros(BUCKETS), math.log(size[1] / size[0]))
    return QualityModel(np.frombuffer(found[0]["weights"], np.float64), found[0]["bias"])


def score_documents(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.score(t.as_py()) for t in b.column("text")], pa.float64())], ["doc_id", "score"])
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
