"""Fixity audit of archived records with Merkle trees.

A record has the SHA-256 of its bytes. Records are ordered by their key; LEAF consecutive
keys are one offset range, the leaf of the tree; FAN neighbouring nodes make the next level
up to one root. A node holds how many records and bytes lie below it and a digest: of its
children's digests in order, or, in a leaf, of sums over the digests of its records, each bound
to its key. The sums are partial aggregates, so one key with any number of records is no hot
task, and a node has at most FAN children.

Two replicas with equal roots are equal. Otherwise the audit reads the children of differing
nodes only, level by level, and keeps the byte offset of every range on the way: the bytes of
all earlier siblings. Only the records of differing leaves are compared one by one.

Defined results: null urls and bodies count as empty; records without a key stand in ranges
below all others, chosen by their digest; records with one key are compared as a multiset; an
empty replica has no root and differs in every record from one that is not; further columns
are not read.
"""

from __future__ import annotations

import gzip
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import BATCH_BYTES, materialize
from shelfspark.session import small_side

#: Keys of one leaf, children of one node.
LEAF, FAN = 16, 16
_LINE = "\r\n"


# ------------------------------------------------------------------ records
def record_bytes(url: Column, body: Column) -> Column:
    """A WARC resource record; its id is made from the url, so it is the same on every run."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit(f"WARC/1.1{_LINE}WARC-Type: resource{_LINE}WARC-Record-ID: <urn:md5:"), F.md5(url.cast("binary")), F.lit(f">{_LINE}WARC-Target-URI: "), url,
                    F.lit(f"{_LINE}Content-Type: text/html{_LINE}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_LINE + _LINE))
    return F.concat(head, body, F.lit(_LINE + _LINE)).cast("binary")


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, record): the pages as archive records."""
    return pages.select(F.col(key).cast("long").alias("key"), record_bytes(F.col(url), F.col(body)).alias("record"))


def fingerprints(records: DataFrame) -> DataFrame:
    """(leaf, key, sha, n_bytes) of every record."""
    out = records.select("key", F.sha2("record", 256).alias("sha"), F.octet_length("record").cast("long").alias("n_bytes"))
    nameless = -F.pmod(F.xxhash64("sha"), F.lit(1 << 30)) - (1 << 60)
    return out.withColumn("leaf", _floor_div(F.coalesce(F.col("key"), nameless), LEAF))


def _floor_div(x: Column, by: int) -> Column:
    """Whole-number division towards minus infinity, exact for 64-bit numbers."""
    bits = by.bit_length() - 1
    return F.shiftright(x, bits)


# ------------------------------------------------------------------ trees
@dataclass
class MerkleTree:
    """Levels from the leaves (0) to the root: (level, node, n, n_bytes, digest), written tables."""

    levels: list[DataFrame]

    def root(self) -> str | None:
        row = self.levels[-1].select("digest").first()
        return row["digest"] if row else None


def _leaves(prints: DataFrame) -> DataFrame:
    bound = F.sha2(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("-")), "sha").cast("binary"), 256)
    prints = prints.select("leaf", "n_bytes", bound.alias("bound"))
    parts = [F.sum(F.conv(F.substring("bound", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = prints.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"), *parts)
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("node", "n", "n_bytes", "s0", "s1", "s2", "s3")]).cast("binary"), 256)
    return sums.select("node", "n", "n_bytes", digest.alias("digest"))


def _parents(level: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("node", "digest")))
    text = F.concat_ws("|", F.transform(listed, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])))
    return (level.groupBy(_floor_div(F.col("node"), FAN).alias("parent")).agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("digest"))
            .withColumnRenamed("parent", "node"))


def height(*prints: DataFrame) -> int:
    """Levels above the leaves after which all given replicas have one node (two, if keys of both
    signs occur: such trees get one root over both)."""
    ends = [r for p in prints if (r := p.agg(F.min("leaf").alias("lo"), F.max("leaf").alias("hi")).first())["lo"] is not None]
    if not ends:
        return 0
    lo, hi, n = min(r["lo"] for r in ends), max(r["hi"] for r in ends), 0
    while lo != hi and not (lo == -1 and hi == 0):
        lo, hi, n = lo // FAN, hi // FAN, n + 1
    return n


def build(prints: DataFrame, levels: int) -> MerkleTree:
    """A tree with ``levels`` levels above its leaves; each is written before the next."""
    out = [materialize(_leaves(prints), "leaves")]
    for _ in range(levels):
        out.append(materialize(_parents(out[-1]), "nodes"))
    return MerkleTree(out)


# ------------------------------------------------------------------ audit
def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, parent, in_a, bytes_a) of nodes that are not the same on both sides."""
    a = a.select("node", F.col("digest").alias("da"), F.col("n_bytes").alias("bytes_a"))
    b = b.select("node", F.col("digest").alias("db"))
    return a.join(b, "node", "full_outer").filter(~F.col("da").eqNullSafe(F.col("db"))).select("node", F.coalesce("bytes_a", F.lit(0)).alias("bytes_a"))


def differing_leaves(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """(leaf, range_offset, range_bytes) of the leaves that differ; offsets and bytes as in ``a``."""
    top = _differing(a.levels[-1], b.levels[-1])
    before = a.levels[-1].select(F.col("node").alias("other"), F.col("n_bytes").alias("other_bytes"))  # two nodes at most
    front = top.join(F.broadcast(before), F.col("other") < F.col("node"), "left").groupBy("node", "bytes_a").agg(F.coalesce(F.sum("other_bytes"), F.lit(0)).alias("offset"))
    for la, lb in zip(a.levels[-2::-1], b.levels[-2::-1]):
        front = materialize(front, "frontier")
        near = small_side(front.select(F.col("node").alias("parent"), F.col("offset").alias("base")), front.count(), 64)
        below_a = la.withColumn("parent", _floor_div(F.col("node"), FAN)).join(near, "parent")
        below_b = lb.withColumn("parent", _floor_div(F.col("node"), FAN)).join(near, "parent")
        # Offsets of all children in their parent; a parent has at most FAN of them on either side.
        kids = below_a.select("parent", "base", "node", F.col("digest").alias("da"), F.col("n_bytes").alias("bytes_a")).join(
            below_b.select("parent", "base", "node", F.col("digest").alias("db")), ["parent", "base", "node"], "full_outer")
        listed = F.array_sort(F.collect_list(F.struct("node", F.coalesce("bytes_a", F.lit(0)).alias("bytes_a"), (~F.col("da").eqNullSafe(F.col("db"))).alias("differs"))))
        per = kids.groupBy("parent", "base").agg(listed.alias("kids"))
        at = F.transform("kids", lambda c, i: F.struct(c["node"].alias("node"), c["bytes_a"].alias("bytes_a"), c["differs"].alias("differs"), F.aggregate(
            F.slice("kids", 1, i), F.lit(0).cast("long"), lambda acc, e: acc + e["bytes_a"]).alias("offset")))
        front = per.select("base", F.explode(at).alias("c")).filter("c.differs").select("c.node", "c.bytes_a", (F.col("base") + F.col("c.offset")).alias("offset"))
    return front.select(F.col("node").alias("leaf"), F.col("offset").alias("range_offset"), F.col("bytes_a").alias("range_bytes"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, status, leaf, range_offset, range_bytes, expected_sha256, found_sha256, n_expected, n_found.

    One row per key whose records differ between the replicas' (key, record) tables: changed,
    missing (only in ``a``) or extra (only in ``b``); the digests are the smallest differing ones."""
    pa_, pb = fingerprints(a), fingerprints(b)
    levels = height(pa_, pb)
    ta, tb = build(pa_, levels), build(pb, levels)
    spark = a.sparkSession
    if ta.root() == tb.root() and ta.levels[-1].count() < 2 and tb.levels[-1].count() < 2:
        leaves = spark.createDataFrame([], "leaf long, range_offset long, range_bytes long")
    else:
        leaves = materialize(differing_leaves(ta, tb), "damaged")
    near = small_side(leaves, leaves.count(), 64)

    def rows(prints: DataFrame, side: int) -> DataFrame:
        return prints.join(near, "leaf").select("leaf", "range_offset", "range_bytes", "key", "sha", F.lit(side).alias("side"))
    both = rows(pa_, 1).unionByName(rows(pb, -1))
    one = both.groupBy("leaf", "range_offset", "range_bytes", "key", "sha").agg(F.sum("side").alias("more")).filter("more <> 0")
    lost, extra = F.col("more") > 0, F.col("more") < 0
    per = one.groupBy("leaf", "range_offset", "range_bytes", "key").agg(
        F.min(F.when(lost, F.col("sha"))).alias("expected_sha256"), F.min(F.when(extra, F.col("sha"))).alias("found_sha256"),
        F.coalesce(F.sum(F.when(lost, F.col("more"))), F.lit(0)).alias("n_expected"), F.coalesce(F.sum(F.when(extra, -F.col("more"))), F.lit(0)).alias("n_found"))
    status = F.when(F.col("n_found") == 0, "missing").when(F.col("n_expected") == 0, "extra").otherwise("changed")
    return per.withColumn("status", status)


# ------------------------------------------------------------------ files
#: Bytes given to the decompressor at once.
_READ = 1 << 16


def _member(view: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at a place, and its length; a member cut short ends with the file."""
    unzip, out, to = zlib.decompressobj(wbits=31), [], at
    while not unzip.eof and to < len(view):
        out.append(unzip.decompress(view[to:to + _READ]))
        to = min(to + _READ, len(view))
    out.append(unzip.flush())
    return b"".join(out), to - len(unzip.unused_data) - at


def parse_warc(data: bytes):
    """(offset, length, headers, body) of every record of a WARC file, plain or gzipped per record.

    Every byte is read once, whatever the number of records."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at:at + 2] == b"\x1f\x8b":
            record, size = _member(view, at)
            head, _, rest = record.partition(b"\r\n\r\n")
        else:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                return
            head, rest, size = data[at:end], None, None
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        n = int(headers.get("Content-Length", 0))
        body = rest[:n] if rest is not None else data[end + 4:end + 4 + n]
        size = size if size is not None else end + 4 + n + 4 - at
        yield at, size, headers, body
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record_id, uri, type, body) of the WARC files below a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, offset long, length long, record_id string, uri string, type string, body binary"

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows, size = [], 0
                for at, n, h, body in parse_warc(data):
                    rows.append((name, at, n, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Type"), body))
                    size += len(body)
                    if size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.string()) for c in cols[3:6]), pa.array(cols[6], pa.binary())],
            ["file", "offset", "length", "record_id", "uri", "type", "body"])
    return files.mapInArrow(run, schema)


def gzip_records(records: list[bytes]) -> bytes:
    """A WARC file with one gzip member per record."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)
