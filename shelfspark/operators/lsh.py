"""Approximate nearest vectors: random-hyperplane tables with multi-probe search, scored exactly.

A table gives a vector one bit per hyperplane (the side it lies on). A query reads, in every
table, the bucket of its own code and those that differ in any of its ``probe_bits`` least certain
bits (smallest distance to the plane): 2^probe_bits buckets. What is read is scored by
exact cosine. The number of bits follows the number of vectors; ``probe_bits`` is found by
measuring: a bounded set of stored vectors is searched exactly, and the smallest number that
finds the wanted share of their neighbours is taken. Where that reads half of the rows or
more, the search is exact.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.operators import vectors as exact
from shelfspark.operators.keyed import top_per_key
from shelfspark.session import materialize

TABLES = 12
#: Vectors per bucket aimed at, and bits at most.
BUCKET_ROWS, MAX_BITS = 32, 24
#: Calibration: vectors searched exactly, and the share of neighbours to be found.
CALIBRATION_ROWS, RECALL = 128, 0.95
#: Queries whose buckets are looked up at once; codes handed to the reader as a filter.
BLOCK_QUERIES, FILTER_CODES = 4_096, 4_096


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """(tables * bits, dim) of signs; every sign is a digest of its place, the same on any machine."""
    sign = lambda t, b, i: 1.0 if hashlib.md5(f"{seed}:{t}:{b}:{i}".encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[sign(t, b, i) for i in range(dim)] for t in range(tables) for b in range(bits)]).reshape(tables * bits, dim)


def _sides(x: np.ndarray, normals: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables, bits): distances to the planes, to six digits of the unit vector."""
    return np.round(exact._unit(x) @ normals.T, 6).reshape(len(x), tables, -1) + 0.0


def _codes(sides: np.ndarray) -> np.ndarray:
    return ((sides >= 0) << np.arange(sides.shape[2])).sum(2)


@dataclass(frozen=True)
class LshIndex:
    """``postings(tbl, code, <vec_id>, v)`` in ranges of table and code, and how they were made."""

    postings: DataFrame
    vec_id: str
    rows: int
    dim: int
    tables: int
    bits: int
    seed: int

    @classmethod
    def build(cls, vectors: DataFrame, vec_id: str = "doc_id", vec: str = "embedding", *, tables: int = TABLES, bits: int | None = None, seed: int = 1,
              path: str | None = None) -> LshIndex:
        """Vectors that are null, or of another length than the longest, are left out. With ``path`` the index is saved there."""
        spark = vectors.sparkSession
        dim = vectors.agg(F.max(F.size(vec))).first()[0] or 0
        v = vectors.select(F.col(vec_id), F.col(vec).alias("v")).filter((F.size("v") == dim) & (F.size("v") > 0))
        n = v.count()
        bits = bits or min(MAX_BITS, max(1, round(math.log2(max(2, n) / BUCKET_ROWS))))
        normals = spark.sparkContext.broadcast(planes(dim, tables, bits, seed))
        schema = T.StructType([T.StructField("tbl", T.IntegerType()), T.StructField("code", T.LongType()), *v.schema.fields])

        def run(batches):
            for b in batches:
                for at in range(0, len(b), 2048):
                    x = b.slice(at, 2048)
                    codes = _codes(_sides(exact._matrix(x.column("v")), normals.value, tables))
                    pick = pa.array(np.repeat(np.arange(len(x)), tables))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), len(x)), pa.int32()), pa.array(codes.reshape(-1), pa.int64()),
                                                      x.column(vec_id).take(pick), x.column("v").take(pick)], ["tbl", "code", vec_id, "v"])
        entered = v.mapInArrow(run, schema).repartitionByRange("tbl", "code", vec_id).sortWithinPartitions("tbl", "code")
        made = {"vec_id": vec_id, "rows": n, "dim": dim, "tables": tables, "bits": bits, "seed": seed}
        if path is None:
            return cls(materialize(entered, "lsh"), **made)
        entered.write.mode("overwrite").parquet(f"{path}/postings")
        spark.createDataFrame([(json.dumps(made),)], "made string").coalesce(1).write.mode("overwrite").text(f"{path}/made")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LshIndex:
        return cls(spark.read.parquet(f"{path}/postings"), **json.loads(spark.read.text(f"{path}/made").first()[0]))

    def vectors(self) -> DataFrame:
        """The indexed vectors, each once."""
        return self.postings.filter("tbl = 0").select(self.vec_id, F.col("v").alias("embedding"))

    def calibrate(self, k: int, recall: float = RECALL, sample: int = CALIBRATION_ROWS) -> int | None:
        """The least number of probed bits that finds ``recall`` of the ``k`` nearest of about ``sample``
        stored vectors; None where that reads half of the rows or more."""
        share = F.pmod(F.xxhash64(self.vec_id), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, self.rows)))
        v = self.vectors()
        asked = materialize(v.filter(share).orderBy(F.xxhash64(self.vec_id), self.vec_id).limit(4 * sample), "asked")
        queries = asked.select(F.col(self.vec_id).alias("query_id"), "embedding")
        near = exact.nearest(v, queries, k + 1, vec_id=self.vec_id).filter(F.col("query_id") != F.col(self.vec_id)).select("query_id", self.vec_id)
        pairs = (near.join(v.withColumnRenamed("embedding", "b"), self.vec_id).join(F.broadcast(queries.withColumnRenamed("embedding", "a")), "query_id")
                 .select("a", "b").toArrow())  # 4 * sample * k rows at most
        if not len(pairs):
            return 0
        normals = planes(self.dim, self.tables, self.bits, self.seed)
        a, b = (_sides(exact._matrix(pairs.column(c)), normals, self.tables) for c in ("a", "b"))
        certain = np.argsort(np.argsort(np.abs(a), axis=2, kind="stable"), axis=2, kind="stable") + 1
        needed = np.where((a >= 0) != (b >= 0), certain, 0).max(2).min(1)  # bits to probe, in the best table
        bits = int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
        return bits if self.tables * 2.0 ** (bits - self.bits) < 0.5 else None


def _probes(q: np.ndarray, normals: np.ndarray, tables: int, probe_bits: int) -> np.ndarray:
    """(queries, tables, 2^probe_bits): codes read by every query."""
    sides = _sides(q, normals, tables)
    least = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :probe_bits]
    flips = np.zeros((len(q), tables, 1), np.int64)
    for i in range(least.shape[2]):
        flips = np.concatenate([flips, flips | (1 << least[:, :, i:i + 1])], axis=2)
    return _codes(sides)[:, :, None] ^ flips


def nearest(index: LshIndex, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "embedding",
            probe_bits: int | None = None, recall: float = RECALL) -> DataFrame:
    """Approximate cosine top-``k`` per query: (query_id, <vec_id>, score, rank); scores are exact.

    Queries go to the tasks in blocks; the postings are read in place, and only in the row groups of
    the wanted codes where these are few. A task hands on ``k`` rows per query.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("embedding"))
    if probe_bits is None:
        probe_bits = index.calibrate(k, recall)
        if probe_bits is None:
            return exact.nearest(index.vectors(), q, k, vec_id=index.vec_id)
    probe_bits = min(probe_bits, index.bits)
    size = q.count()
    blocks = max(1, -(-size // max(1, BLOCK_QUERIES >> max(0, probe_bits - 4))))
    normals = planes(index.dim, index.tables, index.bits, index.seed)
    schema = T.StructType([q.schema["query_id"], index.postings.schema[index.vec_id], T.StructField("score", T.DoubleType())])
    found = None
    for block in exact._sent(q.filter(F.size("embedding") == index.dim).withColumnRenamed("embedding", "_v"), blocks):
        ids, unit = block.value
        if not ids:
            continue
        codes = _probes(unit, normals, index.tables, probe_bits)
        key = (codes << 8 | np.arange(index.tables)[None, :, None]).reshape(len(ids), -1)
        order = np.argsort(key.reshape(-1), kind="stable")
        wanted, start = np.unique(key.reshape(-1)[order], return_index=True)
        asking = order // key.shape[1]
        postings = index.postings
        if len(wanted) <= FILTER_CODES:
            postings = postings.filter(F.col("code").isin(sorted({int(w) >> 8 for w in wanted})))
        part = _search(postings, block, index.postings.sparkSession.sparkContext.broadcast((wanted, np.r_[start, len(order)], asking)), index.vec_id, k, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.postings.sparkSession.createDataFrame([], schema)
    best = found.groupBy("query_id", index.vec_id).agg(F.max("score").alias("score"))
    return top_per_key(best, ["query_id"], [F.col("score").desc(), F.col(index.vec_id)], k)


def _search(postings: DataFrame, block, lookup, vec_id: str, k: int, schema: T.StructType) -> DataFrame:
    """The ``k`` best vectors per query of every task, over the buckets that the queries read."""
    out = to_arrow_schema(schema)

    def run(batches):
        (ids, unit), (wanted, start, asking) = block.value, lookup.value
        best = None
        for b in batches:
            own = b.column("code").to_numpy() << 8 | b.column("tbl").to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == own)
            for lo in range(0, len(hit), 2048):
                rows = hit[lo:lo + 2048]
                many = start[at[rows] + 1] - start[at[rows]]
                query = asking[np.repeat(start[at[rows]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                row = np.repeat(np.arange(len(rows)), many)
                x = exact._unit(exact._matrix(b.column("v").take(pa.array(rows))))
                names = b.column(vec_id).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                for c in range(0, len(row), 1 << 16):
                    i, j = row[c:c + (1 << 16)], query[c:c + (1 << 16)]
                    mine = (j, names[i], np.round(np.einsum("nd,nd->n", x[i], unit[j]), 6) + 0.0)
                    best = _keep(mine if best is None else tuple(np.concatenate(p) for p in zip(best, mine)), k)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best[0]], out.field(0).type), pa.array(best[1], out.field(1).type), pa.array(best[2])], schema=out)
    return postings.select("tbl", "code", vec_id, "v").mapInArrow(run, schema)


def _keep(found: tuple, k: int) -> tuple:
    """The ``k`` best different vectors per query."""
    query, ids, scores = found
    order = np.lexsort((-scores, ids, query))
    q, i = query[order], ids[order]
    once = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]]
    return exact.cut(query[once], ids[once], scores[once], k)
