"""Matching a list of expected titles against the titles of the library."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark import fixed_values as V
from shelfspark.functions.extract import canon_pairs, detail_part, has_year
from shelfspark.functions.fold import audit_norm
from shelfspark.operators.keyed import keep_first
from shelfspark.session import materialize, small_side


#: Bytes of phrases in one automaton.
PHRASE_BYTES = 2 << 20


def _sized(df: DataFrame, bytes_of: str) -> tuple[int, int]:
    """Rows, and bytes of a text column."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(bytes_of)), F.lit(0))).first())


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """All phrases as whole words, each with its place in the list."""
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(f" {w} ", i)
    out.make_automaton()
    return out


def _phrases_in_texts(phrases: DataFrame, p_key: str, p_norm: str, texts: DataFrame, t_key: str, t_norm: str, max_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(p_key, t_key): for every phrase the first text that holds it as whole words.

    The phrases go to the tasks as automata (Aho-Corasick) of at most about ``max_bytes`` of text,
    so each text is read once per automaton, whatever the number of phrases; a task keeps the first
    text per phrase, and only these rows are shuffled.
    """
    different = phrases.groupBy(p_norm).agg(F.count(F.lit(1)).alias("_n"))
    _, size = _sized(different, p_norm)
    blocks = max(1, -(-size // max_bytes))
    spark = phrases.sparkSession
    sent = []
    for block in range(blocks):
        mine = different if blocks == 1 else different.filter(F.pmod(F.xxhash64(p_norm), F.lit(blocks)) == block)
        sent.append(spark.sparkContext.broadcast([r[p_norm] for r in mine.select(p_norm).collect()]))
    kind = texts.schema[t_key].dataType.simpleString()
    arrow_kind = to_arrow_type(texts.schema[t_key].dataType)

    def run(batches):
        first: list[dict] = [{} for _ in sent]
        machines = [None] * len(sent)
        for b in batches:
            keys, norms = b.column(t_key).to_pylist(), b.column(t_norm).to_pylist()
            for n, block in enumerate(sent):
                if machines[n] is None or len(sent) > 1:  # of several automata one is held at a time
                    machines = [None] * len(sent)
                    machines[n] = _automaton(block.value)
                seen = first[n]
                if not len(machines[n]):
                    continue
                for key, norm in zip(keys, norms):
                    for _, i in machines[n].iter(f" {norm} "):
                        if i not in seen or key < seen[i]:
                            seen[i] = key
        for block, seen in zip(sent, first):
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([block.value[i] for i in seen]), pa.array(list(seen.values()), arrow_kind)], [p_norm, t_key])
    found = texts.select(t_key, t_norm).mapInArrow(run, f"{p_norm} string, {t_key} {kind}").groupBy(p_norm).agg(F.min(t_key).alias(t_key))
    return phrases.select(p_key, p_norm).join(found, p_norm).select(p_key, t_key)


def _texts_in_phrases(phrases: DataFrame, p_key: str, p_norm: str, texts: DataFrame, t_key: str, t_norm: str) -> DataFrame:
    """(p_key, t_key): for every phrase the first text that is a part of it, as whole words.

    The parts of a phrase that have as many words as some text meet the texts by equality.
    """
    n_words = lambda c: F.size(F.split(c, " "))
    longest = phrases.agg(F.max(n_words(p_norm))).first()[0] or 0
    lengths = sorted(r[0] for r in texts.filter(n_words(t_norm) <= longest).select(n_words(t_norm)).distinct().collect())  # at most the words of the longest phrase
    if not lengths:
        return phrases.sparkSession.createDataFrame([], T.StructType([phrases.schema[p_key], texts.schema[t_key]]))
    w = F.split(p_norm, " ")
    begin = F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)
    parts = (phrases.select(p_key, w.alias("_w"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n")).filter(F.col("_n") <= F.size("_w"))
             .select(p_key, "_w", "_n", F.explode(begin).alias("_at")).select(p_key, F.array_join(F.slice("_w", F.col("_at"), F.col("_n")), " ").alias("_part")))
    parts = materialize(parts.distinct(), "parts")
    rows, size = _sized(parts, "_part")
    side = small_side(parts, rows, 64 + -(-size // max(1, rows)))
    return texts.join(side, texts[t_norm] == side["_part"]).groupBy(p_key).agg(F.min(t_key).alias(t_key))


def expected_titles(blocks: DataFrame, text: str, order: str) -> DataFrame:
    """(title, author) of a list of 'Title (Author)' items, the first of every normalised title."""
    pairs = blocks.select(F.col(order).alias("_block"), F.posexplode(canon_pairs(text)).alias("_place", "pair")).select("_block", "_place", "pair.*")
    named = pairs.withColumn("_norm", audit_norm("title")).filter("_norm <> ''")
    return keep_first(named, ["_norm"], [F.col("_block"), F.col("_place")]).select("title", "author")


def match_titles(canon: DataFrame, titles: DataFrame, *, canon_id: str = "canon_id", title: str = "title",
                 position: str = "position", both_ways: bool = True) -> DataFrame:
    """(canon_id, position, how): the first library title that equals the expected one, else
    the first one that contains it, or is contained in it, as whole words.

    Expected titles shorter than four characters match by equality only.
    """
    n = canon.count()
    # Normalised once: every step below reads these forms.
    c = materialize(canon.select(canon_id, audit_norm(title).alias("c_norm")), "expected")
    t = materialize(titles.select(position, audit_norm(title).alias("t_norm")), "titles")
    named, long_c = t.filter(F.col("t_norm") != ""), c.filter(F.length("c_norm") >= 4)
    equal = t.join(small_side(c, n), t["t_norm"] == c["c_norm"]).select(canon_id, position, F.lit("exact").alias("how"))
    found = equal.unionByName(_phrases_in_texts(long_c, canon_id, "c_norm", named, position, "t_norm").withColumn("how", F.lit("contains")))
    if both_ways:
        found = found.unionByName(_texts_in_phrases(long_c, canon_id, "c_norm", named, position, "t_norm").withColumn("how", F.lit("contains")))
    found = found.groupBy(canon_id, "how").agg(F.min(position).alias(position))
    best = found.groupBy(canon_id).agg(
        F.min_by(F.struct(position, "how"), F.when(F.col("how") == "exact", 0).otherwise(1)).alias("m"))
    return canon.select(canon_id).join(small_side(best, n), canon_id, "left").select(
        canon_id, F.col(f"m.{position}").alias(position), F.coalesce("m.how", F.lit("missing")).alias("how"))


def quality_flags(entries: DataFrame, text: str = "text", author: str = "author") -> DataFrame:
    """Missing author, missing year, junk summary."""
    return entries.select(
        "*", F.length(detail_part(text)).cast("long").alias("summary_chars"),
        (F.trim(F.coalesce(F.col(author), F.lit(""))) == "").alias("missing_author"),
        (~has_year(text)).alias("missing_year"),
    ).withColumn("junk_summary", F.col("summary_chars") < V.JUNK_SUMMARY_CHARS)


def coverage_summary(matches: DataFrame, flagged: DataFrame, position: str = "position") -> DataFrame:
    """Present, missing and thin counts with the coverage percentage."""
    j = matches.join(flagged.select(position, "junk_summary", "missing_author", "missing_year"), position, "left")
    thin = F.col("junk_summary") | F.col("missing_author") | F.col("missing_year")
    return j.agg(F.count(F.lit(1)).alias("canon_total"), F.count(position).alias("present"),
                 F.sum(F.col(position).isNull().cast("long")).alias("missing"),
                 F.coalesce(F.sum(thin.cast("long")), F.lit(0)).alias("thin"),
                 F.round(F.count(position) * 100.0 / F.count(F.lit(1)), 0).alias("coverage_pct"))
