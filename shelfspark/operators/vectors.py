"""Embedding texts and exact nearest neighbours."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.functions.fold import tokenize
from shelfspark.operators.keyed import top_per_key
from shelfspark.session import BROADCAST_MAX_BYTES

Embedder = Callable[[Column], Column]


# ------------------------------------------------------------------ embedding
@functools.lru_cache(maxsize=1 << 16)
def _slot(token: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:4], 16) % dim, 1 if digest[4] < "8" else -1


#: Words that are looked at once.
_WORDS = 1 << 18


def slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Parts of about ``_WORDS`` values, whole rows each, whatever the length of the rows."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _WORDS, "right")))
        yield lists.slice(at, to - at)
        at = to


def _hashed(lists: pa.ListArray, dim: int) -> pa.ListArray:
    """Unit vectors of token lists; every different token is hashed once."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    slots = np.array([_slot(t, dim) for t in coded.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(len(lists)), sizes) * dim + slots[codes, 0]
    out = np.bincount(cells, weights=slots[codes, 1], minlength=len(lists) * dim).reshape(-1, dim)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    flat = (out / np.where(norm == 0, 1, norm)).astype(np.float32).ravel()
    return pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * dim, flat)


def hashing_embedder(dim: int = 64) -> Embedder:
    """Default embedder: signed token counts hashed into ``dim`` slots, unit length.

    Needs no model files and gives the same vector on every machine. A real model is
    plugged in as any other ``Column -> Column`` (an iterator pandas UDF).
    """

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:  # as many rows as Spark sends at once: words stay Arrow text, a slice is counted at a time
            yield pa.concat_arrays([_hashed(part, dim) for part in slices(batch)] or [pa.array([], pa.list_(pa.float32()))])

    return lambda text: vectors(tokenize(text))


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "") -> Embedder:
    """Embedder around a model; ``load`` runs once per Python worker, texts go in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            mat = np.asarray(encode([prefix + t for t in batch]), dtype=np.float32)
            norm = np.linalg.norm(mat, axis=1, keepdims=True)
            yield pd.Series(list(mat / np.where(norm == 0, 1, norm)))

    return lambda text: vectors(text)


def embed(df: DataFrame, embedder: Embedder, text: str, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embedder(F.col(text)))


# ------------------------------------------------------------------ nearest neighbours
def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def cut(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query by (score descending, id ascending)."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    order = order[rank < k]
    return query[order], ids[order], scores[order]


#: Similarities that are computed at once.
_CELLS = 1 << 20


def _scan(batches, unit_queries: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query number, id, score): the k best per query over the vectors of ``batches``.

    Slices of vectors meet all queries at once; of a slice only what reaches the k-th best score of
    its query so far is kept."""
    n = len(unit_queries)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if not n:
        return best
    floor = np.full(n, -np.inf) if floor is None else floor
    for all_ids, all_rows in batches:
        step = max(k, _CELLS // n)
        for at in range(0, len(all_ids), step):
            ids, sims = all_ids[at:at + step], np.round(_unit(all_rows[at:at + step]) @ unit_queries.T, 6) + 0.0
            own = np.partition(sims, -k, axis=0)[-k] if len(ids) > k else np.full(n, -np.inf)
            row, query = np.nonzero(sims >= np.maximum(own, floor)[None])
            kept = (query, ids[row], sims[row, query])
            best = cut(*(np.concatenate(p) for p in zip(best, kept)), k) if len(best[0]) else cut(*kept, k)
            full = np.bincount(best[0], minlength=n) >= k
            low = np.full(n, np.inf)
            np.minimum.at(low, best[0], best[2])
            floor = np.where(full, low, -np.inf)
    return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "doc_id", vec: str = "embedding",
            query_id: str = "query_id", query_vec: str = "embedding",
            max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Exact cosine top-``k`` per query: (query_id, <vec_id>, score, rank).

    The query matrix is measured first and goes to the tasks in blocks of at most ``max_bytes``.
    The vectors are neither shuffled nor paired: a task holds a part of its vectors of that
    size at most, meets it with one block after the other and hands on ``k`` rows per query
    and part.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vec)).alias("d")).first()
    need = (size["n"] or 0) * (size["d"] or 0) * 8
    v = vectors.select(F.col(vec_id), F.col(vec).alias("_v"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_v"))
    schema = T.StructType([q.schema["query_id"], v.schema[vec_id], T.StructField("score", T.DoubleType())])
    near = _block_scan(v, q, vec_id, k, schema, max(1, -(-need // max_bytes)), max_bytes)
    return top_per_key(near, ["query_id"], [F.col("score").desc(), F.col(vec_id)], k)


def _sent(q: DataFrame, blocks: int) -> list:
    """The queries as broadcasts of (ids, unit vectors), one block at a time on the driver."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    out = []
    for b in range(blocks):
        table = (q if blocks == 1 else q.filter(part == b)).toArrow()
        out.append(q.sparkSession.sparkContext.broadcast((table.column("query_id").to_pylist(), _unit(_matrix(table.column("_v"))))))
    return out


def _block_scan(v: DataFrame, q: DataFrame, vec_id: str, k: int, schema: T.StructType, blocks: int, max_bytes: int) -> DataFrame:
    """Every part of a task's vectors against the query blocks in turn."""
    sent = _sent(q, blocks)
    out = to_arrow_schema(schema)

    def parts(batches):
        """What is held of the vectors at once: all batches for one block, else about ``max_bytes``."""
        if len(sent) == 1:
            yield ((b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))) for b in batches)
            return
        held, size = [], 0
        for b in batches:
            for at in range(0, len(b), 4096):
                x = b.slice(at, 4096)
                held.append((x.column(0).to_numpy(zero_copy_only=False), _matrix(x.column(1))))
                size += held[-1][1].nbytes
                if size >= max_bytes:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            for block in sent:
                ids, mat = block.value
                query, near, score = _scan(part, mat, k)
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query], out.field(0).type), pa.array(near, out.field(1).type), pa.array(score)], schema=out)

    return v.mapInArrow(run, schema)


def with_distance(near: DataFrame) -> DataFrame:
    """Stores that report a distance: 1 - similarity."""
    return near.withColumn("distance", F.round(1 - F.col("score"), 6))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group, one partial-aggregated average per position."""
    cells = df.select(group, F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec))
