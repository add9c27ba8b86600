"""Byte-level BPE through a minimal acyclic transducer of frequent words.

The most frequent words of the corpus (counted over all texts) are compiled into a minimal
acyclic automaton: equal suffixes share their states, every arc carries the number of words
that sort before it, and the sum along a path is the word's number, which leads to its token
ids. The automaton is a handful of flat arrays in one buffer, memory-mapped by the workers and
walked for many words at once, one byte position per step. Words that it does not hold are
merged exactly, by rank, with a heap over a linked list.

Words are cut as the byte-level pre-tokenizer of the vocabulary file cuts them; its added
special tokens are taken out of the text first, as the library does by default.

Defined results: null and empty texts have no tokens (digests of nothing); every input row gives
one row, an empty table gives an empty table; only the id and text columns are read; ids are
32-bit little-endian in the digest; the decoded text comes from the ids alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import csr_gather, materialize

#: Words of the lexicon and bytes of the longest of them.
LEXICON_WORDS = 32_768
LEXICON_BYTES = 32
#: Fixed value: the pattern of the byte-level pre-tokenizer.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FLUSH = 150_000
_GROUP_CHARS = 1 << 20


# ------------------------------------------------------------------ the automaton
def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """One buffer with the minimal automaton of ``words`` and the ids of each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    states: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    previous = b""

    def settle(depth: int) -> None:
        """Replace the states of the last word below ``depth`` by equal ones met before."""
        while len(path) - 1 > depth:
            state = path.pop()
            form = (final[state], tuple(states[state].items()))
            states[path[-1]][previous[len(path) - 1]] = known.setdefault(form, state)
    for k in order:
        word = words[k]
        depth = len(os.path.commonprefix([word, previous]))
        settle(depth)
        for byte in word[depth:]:
            states.append({})
            final.append(False)
            states[path[-1]][byte] = len(states) - 1
            path.append(len(states) - 1)
        final[path[-1]] = True
        previous = word
    settle(0)

    number: dict[int, int] = {}
    below: dict[int, int] = {}

    stack = [0]
    while stack:  # words below each state, children first
        s = stack[-1]
        rest = [t for t in states[s].values() if t not in below]
        if rest:
            stack.extend(rest)
            continue
        below[s] = final[s] + sum(below[t] for t in states[s].values())
        stack.pop()
    for s in below:
        number[s] = len(number)
    key, target, out = [], [], []
    for s in below:
        passed = int(final[s])
        for byte in sorted(states[s]):
            t = states[s][byte]
            key.append(number[s] * 256 + byte)
            target.append(number[t])
            out.append(passed)
            passed += below[t]
    arcs = np.argsort(np.array(key, np.int64), kind="stable")
    lengths = np.array([len(ids[k]) for k in order], np.int64)
    parts = [np.array(key, np.int64)[arcs], np.array(target, np.int64)[arcs], np.array(out, np.int64)[arcs],
             np.array([final[s] for s in below], np.int64), np.r_[0, np.cumsum(lengths)].astype(np.int64),
             np.array([i for k in order for i in ids[k]], np.int64)]
    head = np.array([number[0], *map(len, parts)], np.int64)
    return b"".join(p.tobytes() for p in (head, *parts))


class Lexicon:
    """A compiled automaton over a memory map."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 7)
        parts, at = [], 7 * 8
        for n in head[1:]:
            parts.append(np.frombuffer(buffer, np.int64, int(n), at))
            at += int(n) * 8
        self.root = int(head[0])
        self.key, self.target, self.out, self.final, self.start, self.ids = parts

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Map the buffer from memory that has no place in any folder."""
        area = mmap.mmap(-1, len(data))
        area.write(data)
        return cls(area)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of every word, -1 where the lexicon does not hold it."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state, total = np.full(n, self.root), np.zeros(n, np.int64)
        live = np.flatnonzero((length > 0) & (length <= LEXICON_BYTES)) if len(self.key) else np.empty(0, np.int64)
        found = np.full(n, -1, np.int64)
        for step in range(LEXICON_BYTES):
            if not len(live):
                break
            key = state[live] * 256 + data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            live, arc = live[ok], arc[ok]
            state[live] = self.target[arc]
            total[live] += self.out[arc]
            done = (length[live] == step + 1)
            end = live[done & (self.final[state[live]] == 1)]
            found[end] = total[end]
            live = live[~done]
        return found


# ------------------------------------------------------------------ the vocabulary
def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def narrow_pattern() -> re.Pattern:
    """The word pattern for texts of the first 256 characters only, its classes spelled out: the
    plain matcher takes half the time. Its first alternatives cannot begin alike, so their
    order is free."""
    chars = lambda p: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(p, chr(c)))
    letter, number, space = chars(r"\p{L}"), chars(r"\p{N}"), chars(r"\s")
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        code = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(code[c] for c in word) if all(c in code for c in word) else word.encode()
        for word, i in special.items():
            self.bytes_of[i] = word.encode()
        self.special = special
        self.single = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pairs = np.array([(a << 32) + b for a, b in self.merges] or [-1], np.int64)
        order = np.argsort(pairs)
        self.pair_key, self.pair_rank = pairs[order], np.array([r for r, _ in self.merges.values()] or [0], np.int64)[order]
        self.pair_new = np.zeros(len(self.merges), np.int64)
        for rank, new in self.merges.values():
            self.pair_new[rank] = new
        self.single_of = np.array(self.single, np.int64)
        self.token_start = np.r_[0, np.cumsum([len(b) for b in self.bytes_of])][:-1].astype(np.int64)
        self.token_length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.words, self.narrow = regex.compile(WORD_PATTERN), narrow_pattern()
        self.specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: the pair of lowest rank first, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words, one after the other, and their numbers. Words of similar
        length are merged side by side, one merge of each per step; long ones by ``merge``."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        number = np.zeros(len(words), np.int64)
        rows, cells = [], []
        low = 0
        for high in (4, 8, 12, 16, 24, 32):
            own = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(own):
                ids, n = self._side_by_side([words[i] for i in own], size[own], high)
                number[own] = n
                rows.append(np.repeat(own, n))
                cells.append(ids)
        for i in np.flatnonzero(size > low):
            ids = np.array(self.merge(words[i]), np.int64)
            number[i] = len(ids)
            rows.append(np.full(len(ids), i))
            cells.append(ids)
        if not rows:
            return np.empty(0, np.int64), number
        order = np.argsort(np.concatenate(rows), kind="stable")
        return np.concatenate(cells)[order], number

    def _side_by_side(self, words: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, none = len(words), len(self.pair_new)
        column = np.arange(width)
        ids = np.full((n, width), -1, np.int64)
        ids[column[None] < size[:, None]] = self.single_of[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width), none, np.int64)
        rank[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        count = size.copy()
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            more = best < none
            live, at, best = live[more], at[more], best[more]
            if not len(live):
                break
            take = np.minimum(column[None] + (column[None] > at[:, None]), width - 1)
            part, ranks = np.take_along_axis(ids[live], take, 1), np.take_along_axis(rank[live], take, 1)
            part[:, -1], ranks[:, -1] = -1, none
            row = np.arange(len(live))
            part[row, at] = self.pair_new[best]
            ranks[row, at] = self._ranks(part[row, at], part[row, np.minimum(at + 1, width - 1)])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(part[left, at[left] - 1], part[left, at[left]])
            ids[live], rank[live] = part, ranks
            count[live] -= 1
        return ids[ids >= 0], count

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of every pair, one more than the last for pairs without one."""
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (b >= 0), self.pair_rank[at], len(self.pair_new))

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand among them as they are written."""
        try:
            text.encode("latin-1")
            words = self.narrow.findall
        except UnicodeEncodeError:
            words = self.words.findall
        if self.specials is None or not self.specials.search(text):
            return words(text)
        out: list[str] = []
        at = 0
        for m in self.specials.finditer(text):
            out += words(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + words(text[at:])

    def decode(self, ids: np.ndarray) -> str:
        return csr_gather(ids, self.token_start, self.token_length, self.token_bytes).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


class Encoder:
    """Encodes groups of texts; keeps the ids of the words it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        found = self.lexicon.find(raw)
        special = np.fromiter((self.vocab.special.get(w, -1) for w in new), np.int64, len(new))
        unseen = np.flatnonzero((found < 0) & (special < 0))
        merged, number = self.vocab.merge_many([raw[i] for i in unseen])
        known = np.flatnonzero(found >= 0)
        start, length = np.zeros(len(new), np.int64), np.ones(len(new), np.int64)
        lex = self.lexicon.start
        length[known] = lex[found[known] + 1] - lex[found[known]]
        length[unseen] = number
        start[known] = np.cumsum(length[known]) - length[known]
        start[unseen] = np.cumsum(number) - number + length[known].sum()
        marks = np.flatnonzero(special >= 0)
        start[marks] = length[known].sum() + len(merged) + np.arange(len(marks))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.start = np.r_[self.start, len(self.flat) + start]
        self.length = np.r_[self.length, length]
        self.flat = np.concatenate([self.flat, csr_gather(found[known], lex[:-1], np.diff(lex), self.lexicon.ids), merged, special[marks]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.vocab.split(t) for t in texts]
        new = set().union(*split).difference(self.number)
        if len(self.number) + len(new) > _FLUSH:
            self._forget()
            new = set().union(*split)
        if len(new) > _FLUSH:  # one group with more words than are kept: text by text, word by word
            return [np.concatenate([np.empty(0, np.int64), *(self._one(w) for w in words)]) for words in split]
        if new:
            self._learn(list(new))
        out = []
        for words in split:
            index = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            out.append(csr_gather(index, self.start, self.length, self.flat))
        return out

    def _one(self, word: str) -> np.ndarray:
        if word in self.vocab.special:
            return np.array([self.vocab.special[word]])
        return np.array(self.vocab.merge(word.encode()))


# ------------------------------------------------------------------ the operator
def word_counts(docs: DataFrame, vocab_path: str, *, text_col: str = "text") -> DataFrame:
    """(word, n): every word that the pre-tokenizer makes, over all texts."""
    def count(batches):
        vocab, seen = vocabulary(vocab_path), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out
        for b in batches:
            for text in b.column(0):
                seen.update(vocab.split(text.as_py()))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab_path: str, *, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled automaton of the most frequent words; its size is bounded by ``words``.

    The smallest count that still counts as frequent comes from a histogram of the counts, so
    no task sorts words and the driver receives the chosen ones only."""
    vocab = vocabulary(vocab_path)
    counts = materialize(word_counts(docs, vocab_path, text_col=text_col).filter((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)), "words")
    step = F.floor(F.log2("n") * 16).cast("int")
    room, least = words, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = [] if least is None else counts.filter(step >= least).select("word").collect()
    raw = [r["word"].encode() for r in top if r["word"] not in vocab.special]
    return compile_lexicon(raw, [vocab.merge(w) for w in raw])


def encode_decode(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS,
                  full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``full`` the ids and the decoded text."""
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, vocab_path, text_col=text_col, words=words))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(vocab_path)
        encoder = Encoder(vocab, Lexicon.mapped(lexicon.value))
        for b in batches:
            for lo, hi in groups(b.column("text"), _GROUP_CHARS):
                ids = encoder.encode(b.column("text").slice(lo, hi - lo).to_pylist())
                decoded = [vocab.decode(x) for x in ids]
                cols = [b.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
    more = ", ids array<int>, decoded string" if full else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def groups(texts: pa.Array, limit: int):
    """Ranges of consecutive texts of about ``limit`` bytes; at least one text each."""
    lo, total = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if len(texts):
        yield lo, len(texts)
