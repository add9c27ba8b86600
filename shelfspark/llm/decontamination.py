"""Benchmark passages in documents, by SimHash windows and exact verification.

Every benchmark item has a fingerprint: 1024 bits, each the sign of a sum of numbers over its
weighted word shingles. A document is read in windows of the items' own lengths; where it is shorter than
an item, it is one window as a whole. The fingerprints are indexed by BLOCKS blocks of 20 or 21
bits: two that differ in at most RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1 bits differ in at most
BLOCK_RADIUS bits of some block, so looking up all values that near to the blocks of a window
finds every item within the radius, and about 5 % of the items of its length besides. What lies
within the radius is compared exactly: weighted Jaccard similarity of the shingle multisets.

Windows are only fingerprinted where a match is possible: a similarity of at least t needs
shingles of items of that very length with at least t times the weight of the window, which
running sums tell for every window. No window that could match is lost by this.

Shingles enter the sums with the root of their weight, so at a similarity of t the expected share
of differing bits is at most acos(2t / (1 + t)) / pi. At the threshold of 0.8 the radius lies 3.7
standard deviations above that: a pair of exactly that similarity is missed with a probability of
about 1e-4 (measured: up to 1.5e-3 where it has four or five shingles), one of 0.82 or more
practically never.

The items are sent to the scan in slices of bounded size, one scan per slice; documents are
neither shuffled nor sorted. Shingle weights are those of the whole benchmark, whatever the
slices: with several of them, each also gets the shingles of more than one item (16 bytes each).
An item takes about 800 bytes of index; a document of any length is fingerprinted in pieces of
at most PIECE_CELLS shingles (or one window).

Defined results: words are the lower-cased runs of letters and digits; an item of fewer than
five words is one shingle, and a document without so many words holds none; an empty table on either
side gives an empty table; only the named columns are read, so further columns of any name do no harm; items and documents without words, null and empty texts match
nothing; repeated rows are judged one by one; equally similar windows give the first one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import csr_gather, mix64

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Bits of a fingerprint, blocks of its index, bits in which the nearest block may differ.
BITS, BLOCKS, BLOCK_RADIUS = 1024, 50, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Shingles that are summed up at once.
PIECE_CELLS = 4096
#: Characters of benchmark text sent to the scan at once.
SLICE_CHARS = 8 << 20
_WORD = re.compile(r"\w+")
_CUTS = np.linspace(0, BITS, BLOCKS + 1).astype(int)
#: Bit of a print -> its value in its block.
_PLACES = np.zeros((BITS, BLOCKS), np.float32)
for _b, (_lo, _hi) in enumerate(zip(_CUTS[:-1], _CUTS[1:])):
    _PLACES[_lo:_hi, _b] = 2.0 ** np.arange(_hi - _lo)
_WIDTH = int(np.diff(_CUTS).max())
_B1 = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 1 << 22


def _flips(width: int) -> np.ndarray:
    """All numbers of ``width`` bits of which at most BLOCK_RADIUS are set."""
    return np.array([sum(1 << b for b in c) for n in range(BLOCK_RADIUS + 1) for c in combinations(range(width), n)], np.int64)


_FLIPS = {int(w): _flips(int(w)) for w in np.unique(np.diff(_CUTS))}


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _B1
        acc += h[j:n + j]
    return mix64(acc + np.uint64(k))


def _values(shingle: np.ndarray) -> np.ndarray:
    """For every shingle and bit a number spread evenly over -255, -253 .. 255. Sums of few signs
    are often nought, and such bits would flip more often than the angle tells."""
    steps = np.arange(1, BITS // 8 + 1, dtype=np.uint64) * _B1
    return mix64(shingle[:, None] + steps).view(np.uint8).astype(np.int64) * 2 - 255


def _running(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Running sums of the weighted values, in whole numbers: equal shingles give equal prints."""
    share = np.round(np.sqrt(weight) * 4096).astype(np.int64)
    return np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(_values(shingle) * share[:, None], axis=0)])


def similarity(a: Counter, b: Counter, weight) -> float:
    """Weighted Jaccard similarity of two multisets."""
    inter = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
    total = sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - inter
    return inter / total if total else 0.0


class Benchmark:
    """Items of one slice: shingle weights of the whole benchmark and an index of fingerprints per length."""

    def __init__(self, items: list[tuple[object, str]], spread: tuple[int, np.ndarray, np.ndarray] | None = None):
        """``spread``: number of items of the whole benchmark, its shingles of more than one item
        (sorted) and how many items have each; None where ``items`` are all."""
        hashed = [(i, word_hashes(t or "")) for i, t in items]
        hashed = [(i, h) for i, h in hashed if len(h)]
        self.ids = [i for i, _ in hashed]
        sets = [shingle_hashes(h, min(SHINGLE_WORDS, len(h))) for _, h in hashed]
        own, count = np.unique(np.concatenate([np.unique(x) for x in sets] or [np.empty(0, np.uint64)]), return_counts=True)
        n, common, n_common = spread or (len(sets), own[count > 1], count[count > 1])
        #: A shingle of few items tells more than one of many. Those of other slices weigh here what they weigh there.
        self.known = np.union1d(own, common)
        count = np.ones(len(self.known))
        count[np.searchsorted(self.known, common)] = n_common
        self.known_weight = 1.0 + np.log(max(n, 1) / count)
        self.unseen = float(1.0 + np.log(max(n, 1)))
        self.weights = dict(zip(own.tolist(), self.known_weight[np.searchsorted(self.known, own)].tolist()))
        self.filter = np.zeros(_FILTER_BITS, bool)
        self.filter[(self.known & np.uint64(_FILTER_BITS - 1)).astype(np.int64)] = True
        self.bags = [Counter(x.tolist()) for x in sets]
        # Known shingle -> numbers of the lengths of its items in this slice.
        words = np.array([len(h) for _, h in hashed], np.int64)
        self.lengths = np.unique(words)
        self.length_of = np.searchsorted(self.lengths, words)
        places = np.searchsorted(self.known, np.concatenate(sets or [np.empty(0, np.uint64)]))
        pairs = np.unique(places * max(1, len(self.lengths)) + np.repeat(self.length_of, [len(x) for x in sets]))
        holder, self.holds = np.divmod(pairs, max(1, len(self.lengths)))
        self.first = np.searchsorted(holder, np.arange(len(self.known)))
        self.n_held = np.searchsorted(holder, np.arange(len(self.known)), "right") - self.first
        self._index(self._item_bits(sets))

    def _item_bits(self, sets: list[np.ndarray]) -> np.ndarray:
        bits, begin = np.zeros((len(sets), BITS), bool), 0
        end = np.cumsum([len(x) for x in sets])
        while begin < len(sets):
            done = end[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(end, done + PIECE_CELLS, "right")))
            s = np.concatenate(sets[begin:stop])
            run = _running(s, self.weigh(s)[1])
            cut = np.r_[done, end[begin:stop]] - done
            bits[begin:stop] = run[cut[1:]] - run[cut[:-1]] > 0
            begin = stop
        return bits

    def _index(self, bits: np.ndarray) -> None:
        """Per block the sorted (length, value) keys, their items, and a bit map of the values."""
        self.prints = np.packbits(bits, axis=1).view(np.uint64)
        values = (bits.astype(np.float32) @ _PLACES).astype(np.int64)
        self.keys, self.items, self.maps = [], [], []
        for b in range(BLOCKS):
            key = self.length_of << _WIDTH | values[:, b]
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.items.append(order.astype(np.int32))
            there = np.zeros(1 << _WIDTH, bool)
            there[values[:, b] ^ self._salt(self.length_of)] = True
            self.maps.append(np.packbits(there, bitorder="little"))

    @staticmethod
    def _salt(length_no):
        """Lengths share the bit maps, each turned by a number of its own."""
        return length_no * 0x9E3B1 & ((1 << _WIDTH) - 1)

    def weigh(self, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every shingle among the known ones (-1: none), and its weight."""
        weight = np.full(len(shingle), self.unseen)
        maybe = np.flatnonzero(self.filter[(shingle & np.uint64(_FILTER_BITS - 1)).astype(np.int64)])
        place = np.full(len(shingle), -1)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, shingle[maybe]), len(self.known) - 1)
            same = self.known[at] == shingle[maybe]
            place[maybe[same]] = at[same]
            weight[maybe[same]] = self.known_weight[at[same]]
        return place, weight

    def candidates(self, length_no: int, bits: np.ndarray) -> np.ndarray:
        """(window, item) pairs of one length that some block brings together."""
        values = (bits.astype(np.float32) @ _PLACES).astype(np.int64)
        found = [np.empty(0, np.int64)]
        for b, width in enumerate(np.diff(_CUTS)):
            for begin in range(0, len(bits), 64):
                near = values[begin:begin + 64, b, None] ^ _FLIPS[int(width)]
                cell = near ^ self._salt(length_no)
                w, j = np.nonzero(self.maps[b][cell >> 3] >> (cell & 7) & 1)
                key = length_no << _WIDTH | near[w, j]
                lo = np.searchsorted(self.keys[b], key)
                n = np.searchsorted(self.keys[b], key, "right") - lo
                found.append((np.repeat(w + begin, n) * len(self.ids)) + csr_gather(np.arange(len(n)), lo, n, self.items[b]))
        return np.stack(np.divmod(np.unique(np.concatenate(found)), max(1, len(self.ids))), 1)

    def near(self, length_no: int, bits: np.ndarray) -> np.ndarray:
        """(window, item) pairs within the radius, found through the blocks; equal prints are looked up once."""
        prints, first, which = np.unique(np.packbits(bits, axis=1).view(f"V{BITS // 8}").ravel(), return_index=True, return_inverse=True)
        pairs = self.candidates(length_no, bits[first])
        prints = prints.view(np.uint64).reshape(-1, BITS // 64)
        pairs = pairs[np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]).sum(axis=1) <= RADIUS]
        lo, hi = (np.searchsorted(pairs[:, 0], which, side) for side in ("left", "right"))
        return np.stack([np.repeat(np.arange(len(bits)), hi - lo), csr_gather(np.arange(len(bits)), lo, hi - lo, pairs[:, 1])], 1)

    def matches(self, text: str, threshold: float) -> dict[int, tuple[float, int]]:
        """Item -> similarity and first word of its best window."""
        h = word_hashes(text)
        best: dict[int, tuple[float, int]] = {}
        for k in np.unique(np.minimum(self.lengths, SHINGLE_WORDS)).tolist():
            s = shingle_hashes(h, k)
            place, weight = self.weigh(s)
            at = np.flatnonzero(place >= 0)
            if not len(at):
                continue
            every = np.r_[0.0, np.cumsum(weight)]
            held = csr_gather(place[at], self.first, self.n_held, self.holds)
            at = np.repeat(at, self.n_held[place[at]])
            for no in np.unique(held).tolist():
                m = min(int(self.lengths[no]), len(h)) - k + 1
                own = np.zeros(len(s))
                own[at[held == no]] = weight[at[held == no]]
                known = np.r_[0.0, np.cumsum(own)]
                start = np.flatnonzero(known[m:] - known[:-m] >= threshold * (every[m:] - every[:-m]) - 1e-9)
                if len(start):
                    fresh = np.cumsum(np.minimum(np.diff(start, prepend=start[0] - m), m)) // PIECE_CELLS
                    for part in np.split(start, np.flatnonzero(np.diff(fresh)) + 1):
                        self._verify(best, s, weight, part, m, no, threshold)
        return best

    def _verify(self, best, s, weight, start, m, length_no, threshold) -> None:
        # The shingles of one window are consecutive, so they are consecutive among those of all windows too.
        inside = np.zeros(int(start[-1] - start[0]) + m + 1, np.int64)
        np.add.at(inside, start - start[0], 1)
        np.add.at(inside, start - start[0] + m, -1)
        cells = np.flatnonzero(np.cumsum(inside) > 0) + start[0]
        run = _running(s[cells], weight[cells])
        rank = np.searchsorted(cells, start)
        for w, item in self.near(length_no, run[rank + m] - run[rank] > 0).tolist():
            at = int(start[w])
            bag = Counter(s[at:at + m].tolist())
            here = dict(zip(s[at:at + m].tolist(), weight[at:at + m].tolist()))
            value = similarity(bag, self.bags[item], lambda x: here[x] if x in here else self.weights[x])
            if value >= threshold - 1e-12 and (item not in best or (-value, at) < (-best[item][0], best[item][1])):
                best[item] = (value, at)


def slices(items: DataFrame, id_col: str, text_col: str, slice_chars: int) -> list:
    """Conditions that cut the items into parts of bounded size (by a hash of the id)."""
    size = items.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    parts = max(1, -(-size // slice_chars))
    return [F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)) == k for k in range(parts)]


def item_spread(items: DataFrame, text_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of items with words, shingles of more than one of them (sorted), items of each."""
    def run(batches):
        for b in batches:
            for text in b.column(0):
                h = word_hashes(text.as_py() or "")
                if len(h):  # null counts the item itself
                    own = np.unique(shingle_hashes(h, min(SHINGLE_WORDS, len(h)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([None, *own.tolist()], pa.int64())], ["shingle"])
    found = items.select(text_col).mapInArrow(run, "shingle long").groupBy("shingle").count().filter("shingle IS NULL OR count > 1").toArrow()
    shingle, count = found.column("shingle").combine_chunks(), found.column("count").to_numpy()
    real = shingle.is_valid().to_numpy(zero_copy_only=False)
    keys = shingle.drop_null().to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return int(count[~real].sum()), keys[order], count[real][order]


def _indexes(items: DataFrame, id_col: str, text_col: str, slice_chars: int):
    """The index of every slice, all with the weights of the whole benchmark."""
    parts = slices(items, id_col, text_col, slice_chars)
    spread = item_spread(items, text_col) if len(parts) > 1 else None
    for part in parts:
        rows = items.filter(part).select(id_col, text_col).orderBy(id_col, text_col).collect()
        yield items.sparkSession.sparkContext.broadcast(Benchmark([(r[0], r[1]) for r in rows], spread))


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text: str = "text", threshold: float = THRESHOLD, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, first_word: the best window of every item in every document that has it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def scan(index) -> DataFrame:
        def run(batches):
            bench = index.value
            for b in batches:
                doc, item, value, first = [], [], [], []
                for i, text in enumerate(b.column("text")):
                    for k, (v, at) in sorted(bench.matches(text.as_py(), threshold).items()):
                        doc.append(i)
                        item.append(bench.ids[k])
                        value.append(round(v, 6))
                        first.append(at)
                if doc:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(item), pa.array(value, pa.float64()),
                                                      pa.array(first, pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])
        return rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long")
    return reduce(DataFrame.unionByName, [scan(x) for x in _indexes(items, item_col, item_text, slice_chars)])


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      threshold: float = THRESHOLD, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no item stands."""
    for index in _indexes(items, item_col, item_text, slice_chars):

        def clean(batches, index=index):
            for b in batches:
                keep = [not index.value.matches(t.as_py() or "", threshold) for t in b.column(text_col)]
                yield b.filter(pa.array(keep, pa.bool_()))
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
