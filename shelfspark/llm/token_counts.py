"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

Two neighbouring characters that no vocabulary piece holds side by side can never be
merged into one token, whatever stands around them: such a place is a *stable boundary*,
and the encoding of a text is the encoding of its left part followed by that of its right
part. A huge text is cut into chunks that overlap. Each overlap is widened until it holds a
stable boundary at which the encodings of the overlap from the left and from the right, with
their offsets, both end a token; where they do not align, the next boundary is tried and the overlap widened.
The neighbours are then encoded separately (in different tasks) and spliced there. The offsets of
the whole chunks must show the same token boundary; should they ever not, the job stops with an
error instead of a wrong count. A text without any such boundary is encoded whole, in one task.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every input row gives one
row, repeated rows and repeated ids included; an empty table gives an empty table; only the
id and text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts above this many characters are spread over several tasks.
HUGE_CHARS = 65_536
OVERLAP_CHARS = 256
_META = "▁"


class PieceEncoder:
    """A SentencePiece model with the pairs of characters that its pieces join."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        joined: set[str] = set()
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i)):
                piece = self.sp.id_to_piece(i)
                joined.update(piece[k:k + 2] for k in range(len(piece) - 1))
        self.joined = joined

    def stable(self, text: str, at: int) -> bool:
        """No piece can span the place before ``text[at]``."""
        return text[at - 1:at + 1].replace(" ", _META) not in self.joined

    def edges(self, spans) -> set[int]:
        """Places in bytes at which a token ends."""
        return {p.end for p in spans} | {0}

    def aligned(self, text: str, at: int, overlap: int) -> bool:
        """The encodings of the overlap as the left and as the right chunk sees it both end a token at ``at``."""
        for lo, hi in ((at - 2 * overlap, at + overlap), (at - overlap, at + 2 * overlap)):
            lo = max(0, lo)
            spans = self.sp.encode(text[lo:hi], return_type="proto").pieces
            if len(text[lo:at].encode()) not in self.edges(spans):
                return False
        return True

    def splice_point(self, text: str, cut: int, overlap: int) -> tuple[int, int]:
        """First stable boundary from ``cut`` on where the encodings align, and the overlap that
        holds it, which doubles until it does; the end of the text if there is none."""
        at = max(cut, 1)
        while True:
            end = min(len(text), cut + overlap)
            while at < end:
                if self.stable(text, at) and self.aligned(text, at, overlap):
                    return at, overlap
                at += 1
            if end == len(text):
                return end, overlap
            overlap *= 2

    def chunks(self, text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int]]:
        """(chunk with its overlaps, first and last place of the part it answers for)."""
        left = reach = 0
        while left < len(text):
            right, wide = self.splice_point(text, min(len(text), left + size), overlap)
            begin = max(0, left - reach)
            yield text[begin:min(len(text), right + wide)], left - begin, right - begin
            left, reach = right, wide

    def count(self, text: str) -> int:
        return len(self.sp.encode(text)) if text else 0

    def count_between(self, chunk: str, lo: int, hi: int) -> int:
        """Tokens of ``chunk[lo:hi]``, both ends being stable boundaries or ends of the text."""
        spans = self.sp.encode(chunk, return_type="proto").pieces
        # The offsets count UTF-8 bytes. The blank that the library puts first and all but one byte
        # token of a character have no width and start where their character starts.
        first, last = len(chunk[:lo].encode()), len(chunk[:hi].encode())
        starts = [p.begin for p in spans]
        ends = self.edges(spans)
        if first not in ends or last not in ends:
            raise ValueError("the encodings do not align at a stable boundary")
        return sum(first <= x < last for x in starts)


@lru_cache(maxsize=2)
def encoder(model_path: str) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(model_path)


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 huge_chars: int = HUGE_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks: one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long_text = F.length("text") > huge_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            n = [enc.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches):
        enc = encoder(model_path)
        for b in batches:
            for i, text in enumerate(b.column("text")):
                for seq, (chunk, lo, hi) in enumerate(enc.chunks(text.as_py(), huge_chars, overlap)):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).slice(i, 1) for c in ("doc_id", "n_bytes", "row")]
                        + [pa.array([seq], pa.int64()), pa.array([chunk], pa.string()), pa.array([lo], pa.int64()), pa.array([hi], pa.int64())],
                        ["doc_id", "n_bytes", "row", "seq", "chunk", "lo", "hi"])

    def spliced(batches):
        enc = encoder(model_path)
        for b in batches:
            n = [enc.count_between(t.as_py(), lo.as_py(), hi.as_py()) for t, lo, hi in zip(b.column("chunk"), b.column("lo"), b.column("hi"))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "n_bytes", "row")] + [pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "row", "n_tokens"])

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = (sized.filter(~long_text).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")
             .withColumn("n_chunks", F.lit(1).cast("long")))
    pieces = (sized.filter(long_text).withColumn("row", F.monotonically_increasing_id())
              .mapInArrow(cut, f"doc_id {kind}, n_bytes long, row long, seq long, chunk string, lo long, hi long")
              .repartition("row", "seq"))
    huge = (pieces.mapInArrow(spliced, f"doc_id {kind}, n_bytes long, row long, n_tokens long")
            .groupBy("row", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks")).drop("row"))
    return short.unionByName(huge).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
