import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfspark.llm.bpe import Encoder, Lexicon, Vocabulary, compile_lexicon, encode_decode, word_counts
from tests.llm.helpers import TEXT_EDGES, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " the", " a", "'s", "'re", " ", "  ", "\n", "\t", "é", "日本", "🙂", "<|endoftext|>", "<|endof", "123", " 45", "!!", " ", "\x1c", "\x85", "ß", "İ", "́",
         "ll", "'LL", "\r\n", "x" * 30, "�", "\x00", "１", "²", "Ⅷ", "_", "-"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


def texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_automaton_numbers_its_words(vocab):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)})
    lexicon = Lexicon.mapped(compile_lexicon(words, [[i, i + 1] for i in range(len(words))]))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"zz", words[0] + b"\xff", b"a" * 400]).tolist() == [-1] * 4
    assert len(lexicon.key) < 0.7 * sum(map(len, words))  # suffixes are shared
    assert [lexicon.ids[lexicon.start[k]] for k in (0, 5)] == [0, 5]
    assert Lexicon.mapped(compile_lexicon([], [])).find([b"a"]).tolist() == [-1]


def test_lexicon_from_a_file(tmp_path):
    (tmp_path / "lexicon").write_bytes(compile_lexicon([b"ab", b"cb"], [[1], [2, 3]]))
    assert Lexicon.open(str(tmp_path / "lexicon")).find([b"cb", b"ab", b"b"]).tolist() == [1, 0, -1]


def test_encodes_and_decodes_like_the_library(library, vocab):
    known = sorted({w for t in texts(100, 7) for w in vocab.split(t) if w not in vocab.special and len(w.encode()) <= 32})[::2]
    raw = [w.encode() for w in known]
    encoder = Encoder(vocab, Lexicon.mapped(compile_lexicon(raw, [vocab.merge(w) for w in raw])))
    for t in texts(1000) + ["a" * 20_000 + "é" * 5_000, ""]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = encoder.encode([t, ""])[0]
        assert got.tolist() == ids
        assert vocab.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_narrow_pattern_cuts_alike(vocab):
    rng = random.Random(9)
    some = [chr(c) for c in range(256)] + ["'s", " a", "  ", "'ll", " '", "12"]
    for _ in range(3000):
        t = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        assert vocab.narrow.findall(t) == vocab.words.findall(t)


def test_merges_side_by_side_equal_single_ones(vocab):
    words = [w.encode() for t in texts(200, 3) for w in vocab.split(t) if w not in vocab.special]
    flat, n = vocab.merge_many(words)
    assert flat.tolist() == [i for w in words for i in vocab.merge(w)] and n.sum() == len(flat)


def test_every_row(spark, library):
    rows = list(enumerate(texts(150, 5))) + TEXT_EDGES + [(3, "again"), (None, "no id")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    for words in (50, 0):
        got = encode_decode(documents(spark, rows), PATH, words=words)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    full = {r.doc_id: r for r in encode_decode(documents(spark, rows[:9]), PATH, full=True).collect()}
    assert all(full[i].ids == library.encode(t, add_special_tokens=False).ids and full[i].decoded == t for i, t in rows[:9])
    assert encode_decode(documents(spark, rows).limit(0), PATH).count() == 0


def test_counts_cover_all_texts(spark, vocab):
    rows = list(enumerate(texts(60, 6))) + [(100, None)]
    want = {}
    for _, t in rows:
        for w in vocab.split(t or ""):
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in word_counts(documents(spark, rows), PATH).collect()} == want
