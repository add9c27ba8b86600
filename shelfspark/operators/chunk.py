"""Splitting texts into chunks: fixed size, sliding window and along sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import ChunkConfig
from shelfspark.functions.ids import chunk_id
from shelfspark.functions.text import single_spaced_words, squeeze
from shelfspark.session import let

STRATEGIES = ("fixed_size", "sliding_window", "sentence_aware")


def _even_spans(n: Column, size: int, step: int) -> Column:
    """Spans at multiples of ``step``; the first span reaching the end is the last one."""
    last = F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * step).alias("start"), F.least(i * step + size, n).alias("end")))


def _sentence_spans(text: Column, cfg: ChunkConfig) -> Column:
    """Greedy fold over the sentence lengths.

    A new chunk starts as many words back as its first sentence is long; that overlap
    is not counted in the running size.
    """
    by_stop = F.split(text, r"(?<=[.!?…]) ")
    sentences = F.when(F.size(by_stop) <= 1, F.split(text, r"[,;\n]+")).otherwise(by_stop)
    lengths = F.filter(F.transform(sentences, lambda s: single_spaced_words(F.trim(s))), lambda k: k > 0)
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("start"), F.lit(0).alias("pos"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, k: Column) -> Column:
        full = (a["run"] + k > cfg.size) & (a["run"] >= cfg.min_size)
        span = F.array(F.struct(a["start"].alias("start"), a["pos"].alias("end")))
        return F.struct(
            F.when(full, k).otherwise(a["run"] + k).alias("run"),
            F.when(full, F.greatest(F.lit(0), a["pos"] - k)).otherwise(a["start"]).alias("start"),
            (a["pos"] + k).alias("pos"),
            F.when(full, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    def finish(a: Column) -> Column:
        tail = F.array(F.struct(a["start"].alias("start"), a["pos"].alias("end")))
        return F.when(a["pos"] > a["start"], F.concat(a["spans"], tail)).otherwise(a["spans"])

    return F.aggregate(lengths, zero, step, finish)


def spans(text: Column, n_words: Column, strategy: str, cfg: ChunkConfig) -> Column:
    if strategy == "fixed_size":
        return _even_spans(n_words, cfg.size, cfg.size - cfg.overlap)
    if strategy == "sliding_window":
        return _even_spans(n_words, cfg.size, cfg.stride)
    if strategy == "sentence_aware":
        return _sentence_spans(text, cfg)
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def chunk(df: DataFrame, strategy: str = "fixed_size", cfg: ChunkConfig = ChunkConfig(),
          doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk; narrow, no shuffle. ``keep`` carries metadata columns along.

    The chunk number counts before the short chunks are dropped.
    """
    base = df.select(doc_id, *keep, squeeze(text).alias("_clean"))
    base = base.withColumn("_words", F.filter(F.split("_clean", " "), lambda w: w != ""))
    base = base.filter(F.size("_words") >= cfg.min_size)
    spanned = base.select(
        doc_id, *keep, "_words",
        F.posexplode_outer(spans(F.col("_clean"), F.size("_words"), strategy, cfg)).alias("i", "span"))
    length = F.col("span.end") - F.col("span.start")
    piece = F.array_join(F.slice("_words", F.col("span.start") + 1, F.greatest(length, F.lit(0))), " ")
    return (spanned.filter(length >= cfg.min_size)
            .select(chunk_id(doc_id, "i").alias("chunk_id"), doc_id, *keep, piece.alias("text"),
                    F.col("span.start").cast("long").alias("start_word"),
                    F.col("span.end").cast("long").alias("end_word"),
                    length.cast("long").alias("word_count"),
                    F.length(piece).cast("long").alias("char_count"),
                    F.lit(strategy).alias("strategy")))


def chunk_lengths(clean: Column, n_words: Column, strategy: str, cfg: ChunkConfig) -> Column:
    """Lengths of the kept chunks of one document, without building any chunk text."""
    return let(spans(clean, n_words, strategy, cfg), lambda s: F.filter(
        F.transform(s, lambda p: p["end"] - p["start"]), lambda k: k >= cfg.min_size))


def strategy_stats(df: DataFrame, cfg: ChunkConfig = ChunkConfig(), text: str = "text") -> DataFrame:
    """Compare the strategies: means over per-document rounded means.

    One scan; each document is reduced inside its own row, so only three partial
    aggregates per task are shuffled.
    """
    clean = df.select(squeeze(text).alias("_clean")).withColumn("n_words", single_spaced_words(F.col("_clean")))
    per = clean.filter(F.col("n_words") >= cfg.min_size).select("n_words", F.explode(F.array(*[
        F.struct(F.lit(s).alias("strategy"), chunk_lengths(F.col("_clean"), F.col("n_words"), s, cfg).alias("lengths"))
        for s in STRATEGIES])).alias("s"))

    def figures(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0), lambda x, y: x + y).cast("long")
        n = F.nullif(F.size(a).cast("long"), F.lit(0).cast("long"))
        return F.struct(n.alias("n"), F.when(n > 0, total).alias("words"), F.round(total / n, 1).alias("avg_words"),
                        F.array_min(a).cast("long").alias("lo"), F.array_max(a).cast("long").alias("hi"),
                        F.when(n > 0, F.round(total / F.greatest("n_words", F.lit(1)), 2)).alias("cov"))

    doc = per.select(F.col("s.strategy").alias("strategy"), let(F.col("s.lengths"), figures).alias("f"))
    return doc.groupBy("strategy").agg(
        F.sum("f.n").alias("n_chunks"), F.sum("f.words").alias("total_words"),
        F.round(F.avg("f.avg_words"), 1).alias("avg_words"),
        F.round(F.min("f.avg_words"), 1).alias("min_avg"), F.round(F.max("f.avg_words"), 1).alias("max_avg"),
        F.min("f.lo").alias("min_words"), F.max("f.hi").alias("max_words"),
        F.round(F.avg("f.cov"), 2).alias("coverage"))
