"""Repeated word passages, found by seed and extend.

Seed: every run of ``SEED_WORDS`` words has a hash; of each ``WINDOW`` consecutive runs the
smallest is an anchor (winnowing), so equal passages of SEED_WORDS + WINDOW - 1 words have an
anchor at the same place inside them wherever they stand. Anchors are joined across documents by
a partial aggregate per hash; one that stands in a single document only cannot lie in a repeat.
The shared anchors go into a bit filter of a fixed size: a false hit costs a few rows and
changes nothing.

Extend: around each shared anchor the match is extended both ways, word by word, to the passages
of the threshold length in which it is the smallest seed. Two places match over that length
exactly if the 96-bit hashes of the extended runs are equal, so equal extensions meet by their
hash and no pair of places is ever built: whole copies of a smaller document are set aside
before (all their windows start there), and a group only keeps its smallest and largest document.
Neighbouring matches of a document are then joined into maximal repeats. Windows are judged on
the input, never on what is left of it.

The groups are aggregates with map-side combining and a join whose hot partitions adaptive
execution splits, so a passage that a third of all documents share is no hot task.

Defined results: null and empty texts have no words and lose none (digest of the empty text);
a document with fewer words than the threshold is left as it is; rows with the same id are one
document for the comparison, each judged by its own text; a null id counts as the largest; every
input row gives one row; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialize, mix64
from shelfspark.session import small_side

#: Words of a passage that counts as repeated, of a seed, and seeds among which one is chosen.
MIN_WORDS = 13
SEED_WORDS = 6
WINDOW = MIN_WORDS - SEED_WORDS + 1
#: Bits of the filter of shared anchors: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NULL_ID = (1 << 63) - 1


def split_words(text: str) -> list[bytes]:
    """Runs of characters other than blank, tab and the line breaks; bytes.split() cuts at just these six."""
    return text.encode().split()


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word."""
    n = len(words)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    return one, mix64(one * _B1 + np.fromiter(map(len, words), np.uint64, n))


def run_hashes(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of every run of ``length`` consecutive words."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for k in range(1, length):
        acc *= base
        acc += h[k:n + k]
    return mix64(acc)


def smallest_seed(seeds: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest seed (the first of equal ones) of every ``window`` consecutive seeds."""
    n = len(seeds) - window + 1
    least, at = seeds[:n].copy(), np.arange(n)
    for k in range(1, window):
        less = seeds[k:n + k] < least
        least[less] = seeds[k:n + k][less]
        at[less] = np.flatnonzero(less) + k
    return at


def _seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seeds = run_hashes(h, SEED_WORDS, _B1)
    at = np.unique(smallest_seed(seeds, WINDOW))
    return at, seeds[at]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by their own key, the document and a hash of the text. ``copy``: a smaller document
    has the same text, so every window of the row starts there and none needs to be compared."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"),
                       F.xxhash64(text).alias("tid"), text.alias("text"))
    same = materialize(rows.groupBy("tid", F.md5("text").alias("digest")).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                       .filter("first < last").select("tid", "digest", "first"), "copies")
    size = same.count()
    side = small_side(same, size, 96)
    rows = (rows.withColumn("digest", F.md5("text")).join(side, ["tid", "digest"], "left")
            .select("doc_id", "doc", "tid", "text", F.coalesce(F.col("first") < F.col("doc"), F.lit(False)).alias("copy")))
    # Too many copies to be sent to the scan: the texts are then joined once and written, not three times.
    return rows if side is not same else materialize(rows, "marked")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """Hashes of the anchors that stand in more than one document."""
    def emit(batches):
        for b in batches:
            keys, seeds = [], []
            for key, text in zip(b.column("doc").to_pylist(), b.column("text")):
                words = split_words(text.as_py())
                if len(words) >= MIN_WORDS:
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    seeds.append(np.unique(_seeds(h)[1]).view(np.int64))
                    keys.append(np.full(len(seeds[-1]), key, np.int64))
            if seeds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds)), pa.array(np.concatenate(keys))], ["seed", "doc"])
    return (rows.filter("NOT copy").select("doc", "text").mapInArrow(emit, "seed long, doc long")
            .groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("seed"))


def bit_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bits per hash in an array of ``bits`` bits; only its words that are not zero are gathered."""
    places = F.array(F.pmod("seed", F.lit(bits)), F.pmod(F.shiftright("seed", 27), F.lit(bits)))
    words = (seeds.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, int(p & 63))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def in_filter(seeds: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = np.int64(len(words) * 64)
    s = seeds.view(np.int64)
    a, b = np.mod(s, n), np.mod(s >> np.int64(27), n)
    return ((words[a >> 6] >> (a & 63)) & (words[b >> 6] >> (b & 63)) & 1).astype(bool)


def extensions(rows: DataFrame, words_of_filter) -> DataFrame:
    """(h1, h2, doc, tid, place) of every window whose smallest seed is a shared anchor."""
    def emit(batches):
        bits = words_of_filter.value
        for b in batches:
            parts: list[list[np.ndarray]] = []
            for doc, tid, text in zip(b.column("doc").to_pylist(), b.column("tid").to_pylist(), b.column("text")):
                words = split_words(text.as_py())
                n = len(words) - MIN_WORDS + 1
                if n <= 0:
                    continue
                one, two = word_hashes(words)
                seeds = run_hashes(one, SEED_WORDS, _B1)
                owner = smallest_seed(seeds, WINDOW)
                hit = np.zeros(len(seeds), bool)
                at = np.unique(owner)
                hit[at] = in_filter(seeds[at], bits)
                place = np.flatnonzero(hit[owner])
                if len(place):
                    h1, h2 = run_hashes(one, MIN_WORDS, _B1)[place], run_hashes(two, MIN_WORDS, _B2)[place]
                    k = len(place)
                    parts.append([h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(k, doc, np.int64),
                                  np.full(k, tid, np.int64), place.astype(np.int32)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["h1", "h2", "doc", "tid", "place"])
    return rows.filter("NOT copy").select("doc", "tid", "text").mapInArrow(emit, "h1 long, h2 int, doc long, tid long, place int")


def maximal_repeats(rows: DataFrame, *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc, tid, starts, ends): word places of the maximal repeats of every row that has any and
    is no copy, being the unions of windows that also start in a smaller document."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(shared_anchors(rows), filter_bits))
    windows = extensions(rows, bits)
    # Written first: the join then reads both sides anew and adaptive execution can split its hot keys.
    groups = materialize(windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
                         .select("h1", "h2", "first"), "shared-windows")
    later = windows.join(groups, ["h1", "h2"]).filter("first < doc").select("doc", "tid", "place")

    def merge(key, found):
        place = np.unique(found.column("place").to_numpy())
        cut = np.flatnonzero(np.diff(place) > MIN_WORDS) + 1
        start, end = place[np.r_[0, cut]], place[np.r_[cut - 1, len(place) - 1]] + MIN_WORDS
        return pa.table({"doc": [key[0].as_py()], "tid": [key[1].as_py()], "starts": pa.array([start.tolist()], pa.list_(pa.int32())),
                         "ends": pa.array([end.tolist()], pa.list_(pa.int32()))})
    return later.groupBy("doc", "tid").applyInArrow(merge, "doc long, tid long, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: every row with its repeats taken out."""
    keyed = _keyed(docs, id_col, text_col)
    found = materialize(maximal_repeats(keyed, filter_bits=filter_bits), "repeats")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("k")).first()
    # Few repeats go to the scan as a broadcast of measured size; otherwise both sides are shuffled by document.
    found = small_side(found, size["n"], 64 + 16 * (size["k"] // max(size["n"], 1) + 1))
    rows = keyed.join(found, ["doc", "tid"], "left").select("doc_id", "text", "copy", "starts", "ends")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            n, gone, kept, sha = [], [], [], []
            for text, copy, start, end in zip(b.column("text"), *[b.column(c).to_pylist() for c in ("copy", "starts", "ends")]):
                words = split_words(text.as_py())
                if copy and len(words) >= MIN_WORDS:
                    start, end = [0], [len(words)]
                left, at = [], 0
                for lo, hi in zip(start or (), end or ()):
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return rows.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
