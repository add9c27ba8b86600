import random

import public_tokenizers
import pytest
import sentencepiece

from shelfspark.llm.token_counts import PieceEncoder, count_tokens
from tests.llm.helpers import TEXT_EDGES, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the ", "a", " ", "  ", "\n", "é", "日本", "▁", "x▁", "<s>", "ing", "\t", "!!", "ABC ", "1234", "🙂", "\u0000", "🧿"]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(MODEL)


def test_spliced_chunks_count_like_the_whole(encoder):
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(200)))
        size, overlap = rng.choice([3, 10, 40]), rng.choice([1, 2, 8])
        assert sum(encoder.count_between(*c) for c in encoder.chunks(text, size, overlap)) == encoder.count(text)


def test_overlap_widens_until_a_boundary(encoder):
    text = "ab" * 300 + "\n" + "c"
    at, overlap = encoder.splice_point(text, 10, 4)
    assert at >= 11 and overlap >= at - 10
    assert encoder.splice_point("a" * 500, 50, 4)[0] == 500  # no boundary at all: one chunk


class Doubtful(PieceEncoder):
    """Takes every place for a stable boundary, so that the alignment alone decides."""

    def stable(self, text, at):
        return True


def test_misaligned_places_are_passed_over():
    rng, doubtful = random.Random(3), Doubtful(MODEL)
    text = " ".join(rng.choice(["establishment", "counterparts", "internationally", "understanding"]) for _ in range(300))
    cuts = [k for k in range(50, 450) if not doubtful.aligned(text, k, 32)]
    assert len(cuts) > 200  # places inside pieces
    for cut in cuts:
        at, _ = doubtful.splice_point(text, cut, 32)
        assert at > cut and doubtful.aligned(text, at, 32)
    assert sum(doubtful.count_between(*c) for c in doubtful.chunks(text, 100, 32)) == doubtful.count(text)
    # One long piece after the other: the overlap is too narrow to hold a boundary and widens.
    at, overlap = doubtful.splice_point(text, cuts[0], 1)
    assert at > cuts[0] and overlap >= 1


def test_every_row(spark):
    rows = [(i, "the cat sat. " * i + "日本 🙂") for i in range(40)] + [(3, "again")] + [(None, "no id")] + TEXT_EDGES
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, count_tokens(documents(spark, rows), MODEL, huge_chars=100, overlap=4).drop("n_chunks").collect()), key=str)
    n = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows]
    assert got == sorted([(*x, x[2] > 4096) for x in n], key=str)
    assert count_tokens(documents(spark, rows).limit(0), MODEL).count() == 0
