"""Similarity join on word shingles with Bayesian pruning of candidate pairs.

Texts with the same set of shingles form one class; the join works on classes and never
expands copies. Classes that share one of the MinHash bands are candidates. Within a bucket
pairs are compared in blocks of bounded size: after every few MinHash values the posterior
probability that the pair reaches the threshold (uniform prior, binomial likelihood) is
looked up, pairs that fall below the tolerance are dropped, the rest is verified exactly on
the shingle sets. A block returns the number of links of each class and a spanning forest of
its links, so a bucket of thousands of similar texts makes rows for its members, not for its
pairs. A bucket above the block size is dealt out to pairs of blocks; buckets with the same
members in several bands are compared once, and a pair counts in its first common band only.

With 32 bands of 4 values a pair at the threshold shares no band with a probability of 5e-8.

Defined results: words are the lower-cased runs of letters and digits; a text of 1 to 4 words is
one shingle; null and empty texts and texts without words have no shingle, no link and stand
alone; rows with the same id are joined by their own texts; a class id is the smallest id among
the linked documents (null if they have none); only the id and text columns are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialize, mix64
from shelfspark.llm.components import connected_components
from shelfspark.session import small_side

SHINGLE_WORDS = 5
THRESHOLD = 0.8
VALUES, BAND_VALUES = 128, 4
#: MinHash values compared between two looks at the posterior, and what it may not fall below.
STEP, TOLERANCE = 32, 1e-6
#: Classes of a bucket compared by one group of rows.
BLOCK = 512
_WORD = re.compile(r"\w+")
_MULTIPLIERS = (mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
_B1 = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE_WORDS, len(words))
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _B1
        acc += h[j:n + j]
    return np.unique(mix64(acc + np.uint64(k)))


def signature(shingle: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set of shingles."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle), 1024):
        np.minimum(out, (shingle[None, at:at + 1024] * _MULTIPLIERS).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    part = sig.reshape(-1, BAND_VALUES).astype(np.uint64)
    acc = np.arange(len(part), dtype=np.uint64)
    for j in range(BAND_VALUES):
        acc = mix64(acc * _B1 + part[:, j])
    return acc.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Fewest matches among the first n values with which P(J >= threshold | matches) reaches
    the tolerance: under a uniform prior that is P(Binomial(n + 1, threshold) <= matches)."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _class_of(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, cls, bands): the class of every row and the band keys of its signature."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cls, bands = [], []
            for text in b.column("text"):
                s = shingles(text.as_py())
                cls.append(_class_of(s))
                bands.append(band_keys(signature(s)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(cls, pa.binary()), pa.array(bands, pa.binary())],
                                             ["doc_id", "text_hash", "cls", "bands"])
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, cls binary, bands binary")


def buckets(groups: DataFrame) -> DataFrame:
    """(cls, band, key, size): members of all band buckets of at least two classes; of buckets
    with the same members only the one of the first band."""
    def explode(batches):
        band = np.arange(VALUES // BAND_VALUES, dtype=np.int32)
        for b in batches:
            n = len(b)
            if n:
                key = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
                cls = b.column("cls").take(pa.array(np.repeat(np.arange(n), len(band))))
                yield pa.RecordBatch.from_arrays([cls, pa.array(np.tile(band, n)), pa.array(key)], ["cls", "band", "key"])
    members = groups.select("cls", "bands").mapInArrow(explode, "cls binary, band int, key long")
    one, two = F.xxhash64("cls").cast("decimal(20,0)"), F.xxhash64("cls", F.lit(1)).cast("decimal(20,0)")
    shared = (members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum(one).alias("m1"), F.sum(two).alias("m2")).filter("size > 1")
              .groupBy("size", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("first")).select("first.band", "first.key", "size"))
    shared = materialize(shared, "buckets")
    return members.join(small_side(shared, shared.count(), 64), ["band", "key"])


def _pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that survive the incremental comparison and first meet in ``band``."""
    match = np.zeros(len(left), np.int32)
    for n in range(STEP, VALUES + 1, STEP):
        match += (sig[left, n - STEP:n] == sig[right, n - STEP:n]).sum(axis=1, dtype=np.int32)
        keep = match >= least[n]
        left, right, match = left[keep], right[keep], match[keep]
    if band and len(left):
        same = (sig[left, :band * BAND_VALUES] == sig[right, :band * BAND_VALUES]).reshape(len(left), band, BAND_VALUES).all(axis=2).any(axis=1)
        left, right = left[~same], right[~same]
    return left, right


def _compare(cls: list[bytes], copies: np.ndarray, side: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], band: int,
             least: dict[int, int], threshold: float):
    """Links per class of a block and the edges of a spanning forest. ``side``: 0 and 1 for the
    two halves of a pair of blocks (links across only), 2 for a block of its own."""
    n = len(cls)
    links, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    edges = []
    sizes = np.array([len(s) for s in sets])
    for i in range(n):
        if side[i] == 1:
            continue
        other = np.flatnonzero(side == 1) if side[i] == 0 else np.arange(i + 1, n)
        # Sets whose sizes differ too much cannot be similar.
        fits = np.minimum(sizes[other], sizes[i]) >= threshold * np.maximum(sizes[other], sizes[i])
        other = other[fits]
        a, b = _pairs(sig, np.full(len(other), i), other, band, least)
        for j in b.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                links[[i, j]] += 1
                weight[i] += copies[j]
                weight[j] += copies[i]
                x, y = find(i), find(j)
                if x != y:
                    root[y] = x
                    edges.append((i, j))
    return links, weight, edges


def verify(payload: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links, copies): rows with b are edges, the others carry numbers of links."""
    least = least_matches(threshold)

    def run(batches):
        held: list = []
        at = None

        def flush():
            cls = [r[0] for r in held]
            links, weight, edges = _compare(cls, np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held]),
                                            np.stack([np.frombuffer(r[3], np.uint32) for r in held]), [np.frombuffer(r[4], np.uint64) for r in held],
                                            at[0], least, threshold)
            hit = np.flatnonzero(links).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([cls[i] for i in hit] + [cls[i] for i, _ in edges], pa.binary()), pa.array([None] * len(hit) + [cls[j] for _, j in edges], pa.binary()),
                 pa.array([int(links[i]) for i in hit] + [0] * len(edges), pa.int64()), pa.array([int(weight[i]) for i in hit] + [0] * len(edges), pa.int64())],
                ["a", "b", "links", "copies"])
        for b in batches:
            cols = [b.column(c) for c in ("band", "key", "block", "cls", "n", "side", "sig", "shingles")]
            for r in zip(*cols):
                band, key, block, *rest = (x.as_py() for x in r)
                if at != (band, key, block):
                    if len(held) > 1:
                        yield flush()
                    held, at = [], (band, key, block)
                held.append(rest)
        if len(held) > 1:
            yield flush()
    return payload.mapInArrow(run, "a binary, b binary, links long, copies long")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copy_of, n_links, n_class_links, text_hash: one row per row of ``docs``.

    ``n_links`` counts the other documents at the threshold or above, copies included;
    ``n_class_links`` the different texts among them; ``copy_of`` is the smallest id with the
    same shingles; ``class_id`` the smallest id among all documents linked directly or not."""
    rows = materialize(classes(docs, id_col=id_col, text_col=text_col), "classes")
    groups = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    groups = materialize(groups, "groups")
    member = materialize(buckets(groups), "members")
    wanted = member.select("cls").distinct()
    wanted = small_side(wanted, wanted.count(), 64)

    def load(batches):
        for b in batches:
            cls, sig, sets = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py())
                cls.append(_class_of(s))
                sig.append(signature(s).tobytes())
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], ["cls", "sig", "shingles"])
    # One text per wanted class: the class of a row is known, so only chosen rows are read again.
    chosen = _chosen_rows(docs, rows, wanted, id_col, text_col)
    texts = chosen.mapInArrow(load, "cls binary, sig binary, shingles binary").dropDuplicates(["cls"])
    texts = materialize(texts.join(groups.select("cls", "n"), "cls"), "texts")

    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cls", "band"), F.col("blocks")).cast("int")
    dealt = (member.withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("block", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
             .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
             .select("band", "key", "block", "side", "cls"))
    payload = (dealt.join(texts, "cls")
               .repartition("band", "key", "block").sortWithinPartitions("band", "key", "block"))
    found = materialize(verify(payload, threshold), "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    roots = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    named = (groups.select("cls", "copy_of", "n").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left"))
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("copy_of").alias("least"))
    named = (named.join(least, "root", "left")
             .select("cls", "copy_of", F.coalesce("least", "copy_of").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_class_links"),
                     (F.coalesce("copies", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return rows.select("doc_id", "text_hash", "cls").join(named, "cls", "left").select(
        "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"), "text_hash")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their class; of rows
    with the same id and text one stays. A class without any id keeps its different texts."""
    found = materialize(jaccard_join(docs, id_col=id_col, text_col=text_col, threshold=threshold), "similar")
    dropped = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_hash").distinct()
    dropped = materialize(dropped, "dropped")
    dropped = small_side(dropped, dropped.count(), 32)
    same = docs[id_col].eqNullSafe(dropped["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == dropped["text_hash"])
    kept = docs.join(dropped, same, "left_anti")
    repeated = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept


def _chosen_rows(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the rows whose classes are wanted, first ids only; found by id, so texts are
    shuffled only where the chosen ids are too many to be sent to the scan."""
    first = rows.filter("cls IS NOT NULL").join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    ids = materialize(first.select("doc_id").distinct(), "chosen")
    ids = small_side(ids, ids.count(), 32)
    texts = _rows(docs, id_col, text_col)
    return texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
