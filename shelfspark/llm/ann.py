"""Approximate nearest neighbours over balanced posting lists.

Fit: centroids from a sample (bounded by parameters and the square root of the table), by k-means whose assignment cost grows with the size of
a cluster, so the lists come out balanced. The centroids form a neighbour graph small enough
for every task's memory.

Index: every vector walks the graph to its nearest centroids and is entered in the nearest list
and in those hardly further away: boundary vectors are replicated.

Search: a query walks the same graph; the distance of a centroid relative to the nearest one
decides which lists are read. How far and how many is measured: a bounded set of stored vectors
is searched exactly, and the least number of lists and the least ratio that find the wanted share of
their neighbours are taken, at every size of the table. Where that is half of all lists, all rows are
compared. Queries and lists meet by a shuffle on the list. A list above
LIST_ROWS rows is dealt out to several parts, and so are the queries of a list, so equal vectors
in any number make no hot task; every part returns k rows per query. Queries that found fewer
than k rows are searched again exactly.

Distances of the result are computed in double precision on the original vectors.

Defined results: vectors that are null, zero or hold null or non-finite components, rows without
an id, and vectors of another length than the most frequent one (the longer of equals) take no
part; rows with one id are one candidate (the nearest counts); ties go to the smaller id; no
vector gives no row; only the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import hash_share, materialize

#: Vectors per centroid aimed at; beyond 16,384 vectors the lists grow as LISTS times the square root of the table.
PER_CENTROID, LISTS = 64, 8
#: The fit reads about SAMPLE_ROWS vectors, or SAMPLE_PER_LIST for every list where that is more.
SAMPLE_ROWS, SAMPLE_PER_LIST = 32_768, 8
#: Stored vectors that are searched exactly to choose how much a query reads, and what it has to find of them.
CALIBRATION_ROWS, RECALL = 192, 0.97
NEIGHBOURS = 24
#: Width of the walks of rows and of queries.
ROW_BEAM, QUERY_BEAM = 48, 96
#: Replication: lists up to this much further than the nearest, and how many at most.
CLOSURE, REPLICAS = 1.1, 5
#: Search: how many lists at least; where the caller fixes one of the two, lists up to this much
#: further than the nearest and how many at most.
MIN_PROBES, PRUNE, PROBES = 16, 1.25, 64
LIST_ROWS, LIST_QUERIES = 4_096, 2_048
_LOOK = 4


def valid(vector: Column, dim: int) -> Column:
    """A vector that takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the rows that take part, their number and their dimension."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL")
    lengths = rows.filter("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    rows = rows.filter(valid(F.col("v"), dim))
    return rows, rows.count() if dim else 0, dim


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


@dataclass
class CentroidGraph:
    """Centroids, the neighbours of each, and where walks start."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        k = min(NEIGHBOURS, n)
        links = np.stack([np.argsort(_distances(c[None], centroids)[0], kind="stable")[:k] for c in centroids]) if n else np.empty((0, 0), int)
        # Far apart starting points reach every part of the graph.
        entries = [0] if n else []
        far = _distances(centroids[:1], centroids)[0] if n else None
        while len(entries) < min(16, n):
            entries.append(int(far.argmax()))
            far = np.minimum(far, _distances(centroids[entries[-1:]], centroids)[0])
        return cls(centroids, links, np.array(entries, int))

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near every row of ``x`` and their distances, nearest first, by best-first
        walks of all rows at once. Missing places hold infinite distances."""
        m, c = len(x), self.centroids
        width = min(width, len(c))
        norm = (c * c).sum(1)

        def measured(ids: np.ndarray) -> np.ndarray:
            return norm[ids] - 2 * np.einsum("mkd,md->mk", c[ids], x)
        ids = np.tile(self.entries, (m, 1))
        dist = measured(ids)
        done = np.zeros(ids.shape, bool)
        for _ in range(4 * width):
            open_ = np.where(done, np.inf, dist)
            look = np.argsort(open_, axis=1, kind="stable")[:, :_LOOK]
            fresh = np.take_along_axis(open_, look, 1)
            if not np.isfinite(fresh).any():
                break
            np.put_along_axis(done, look, True, 1)
            near = self.links[np.take_along_axis(ids, look, 1)].reshape(m, -1)
            ids, dist, done = (np.concatenate(p, 1) for p in ((ids, near), (dist, measured(near)), (done, np.zeros(near.shape, bool))))
            # Of equal centroids the one already visited stays, the others move to the end.
            order = np.lexsort((~done, ids), axis=1)
            ids, dist, done = (np.take_along_axis(p, order, 1) for p in (ids, dist, done))
            twin = np.zeros(ids.shape, bool)
            twin[:, 1:] = ids[:, 1:] == ids[:, :-1]
            dist = np.where(twin, np.inf, dist)
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(p, order, 1) for p in (ids, dist, done))
            done |= ~np.isfinite(dist)
        exact = np.sqrt(np.maximum(dist + (x * x).sum(1)[:, None], 0))
        order = np.argsort(exact, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means with a penalty on large clusters; empty clusters are dropped."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    size = np.zeros(len(c))
    for _ in range(rounds):
        own = np.empty(len(sample), int)
        even = len(sample) / len(c)
        for at in range(0, len(sample), 2048):
            d = _distances(sample[at:at + 2048], c)
            own[at:at + 2048] = (d * (1 + 0.05 * np.maximum(size / even - 1, 0))[None]).argmin(1)
        size = np.bincount(own, minlength=len(c)).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        keep = size > 0
        c, size = total[keep] / size[keep, None], size[keep]
    return np.unique(c, axis=0)


def n_lists(n: int, per_centroid: int = PER_CENTROID) -> int:
    return max(1, min(n // per_centroid, round(LISTS * n ** 0.5)))


def fit(rows: DataFrame, n: int, *, sample_rows: int = SAMPLE_ROWS, per_centroid: int = PER_CENTROID) -> CentroidGraph:
    """Centroids of a sample, chosen by a hash of the ids; see SAMPLE_ROWS for its size."""
    lists = n_lists(n, per_centroid)
    wanted = max(sample_rows, SAMPLE_PER_LIST * lists)
    sample = rows.filter(hash_share(F.col("vec_id"), wanted, n)).toArrow()
    if not len(sample):  # repeated ids can all fall outside the share
        sample = rows.limit(wanted).toArrow()
    order = np.lexsort((sample.column("vec_id").to_numpy(),))
    x = _matrix(sample.column("v").combine_chunks(), len(sample.column("v")[0]))[order]
    return CentroidGraph.build(balanced_centroids(x, lists))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _entries(rows: DataFrame, graph, dim: int, ratio: float, least: int, most: int, beam: int) -> DataFrame:
    """(list, vec_id, v): every row once for each list chosen for it."""
    def run(batches):
        g = graph.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                x = _matrix(part.column("v"), dim)
                ids, dist = g.nearest(x, beam)
                take = (dist <= ratio * dist[:, :1] + 1e-12) & np.isfinite(dist)
                take[:, :least] = np.isfinite(dist[:, :least])
                take &= np.cumsum(take, 1) <= most
                r, c = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, c].astype(np.int32)), *(part.column(n).take(pa.array(r)) for n in ("vec_id", "v"))], ["list", "vec_id", "v"])
    return rows.select("vec_id", "v").mapInArrow(run, "list int, vec_id long, v array<double>")


def _best(q_id: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest other ids (the nearest row of each) and their distances, ties to smaller ids."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    own = np.flatnonzero(ids != q_id)
    rows = k
    while True:  # rows of one id are one candidate: take more rows until they hold k ids
        near = own
        if len(own) > rows:
            near = own[d[own] <= np.partition(d[own], rows - 1)[rows - 1]]
        near = near[np.lexsort((ids[near], d[near]))]
        _, first = np.unique(ids[near], return_index=True)
        if len(first) >= k or len(near) == len(own):
            near = near[np.sort(first)][:k]
            return near, d[near]
        rows *= 4


_FOUND = "query_id long, vec_id long, score double"


def _search_lists(postings: DataFrame, queries: DataFrame, dim: int, k: int, list_rows: int, list_queries: int) -> DataFrame:
    """The k best rows of every part of every list for each of its queries."""
    rows = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(list_rows)).cast("int").alias("parts"))
    asked = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(list_queries)).cast("int").alias("shares"))
    plan = F.broadcast(materialize(rows.join(asked, "list"), "lists"))  # one row per centroid
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = postings.join(plan, "list").withColumn("part", own("parts")).withColumn("share", every("shares")).select("list", "part", "share", "vec_id", "v")
    right = queries.join(plan, "list").withColumn("share", own("shares")).withColumn("part", every("parts")).select("list", "part", "share", "vec_id", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(a) and len(b):
            ids, x = a.column("vec_id").to_numpy(), _matrix(a.column("v").combine_chunks(), dim)
            for q, v in zip(b.column("vec_id").to_pylist(), _matrix(b.column("v").combine_chunks(), dim)):
                near, d = _best(q, v, ids, x, k)
                out[0].append(np.full(len(near), q))
                out[1].append(ids[near])
                out[2].append(d)
        cat = lambda p, t: pa.array(np.concatenate(p) if p else np.empty(0), t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], ["query_id", "vec_id", "score"])
    keys = ("list", "part", "share")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def _cut(query: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different ids of every query, ties to smaller ids."""
    order = np.lexsort((d, ids, query))
    q, i = query[order], ids[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]] if len(order) else order
    order = order[np.lexsort((ids[order], d[order], query[order]))]
    q = query[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    order = order[np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) < k]
    return query[order], ids[order], d[order]


def exact_search(rows: DataFrame, queries: list[tuple[int, list[float]]], dim: int, k: int) -> DataFrame:
    """The k nearest rows of a stated, bounded set of queries by comparing all rows.

    A matrix product tells which rows may be among the nearest; these are measured exactly."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], float).reshape(-1, dim)))

    def run(batches):
        asked, points = sent.value
        norm = (points * points).sum(1)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        far = np.full(len(asked), np.inf)
        step = 4 * k
        for b in batches:
            all_ids, all_x, at = b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim), 0
            while at < len(all_ids):
                ids, x = all_ids[at:at + step], all_x[at:at + step]
                at, step = at + step, min(4 * step, 2048)
                own = (x * x).sum(1)
                rough = own[:, None] + norm[None] - 2 * x @ points.T
                slack = 1e-9 * (own[:, None] + norm[None]) + 1e-12  # rounding of the product
                row, query = np.nonzero((rough - slack <= (far * far)[None]) & (ids[:, None] != asked[None]))
                if not len(row):
                    continue
                d = np.concatenate([np.sqrt(((x[row[i:i + 65536]] - points[query[i:i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)])
                best = _cut(*(np.concatenate(p) for p in zip(best, (query, ids[row], d))), k)
                last = np.zeros(len(asked))
                np.maximum.at(last, best[0], best[2])
                far = np.where(np.bincount(best[0], minlength=len(asked)) >= k, last, np.inf)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(asked[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])
    return rows.select("vec_id", "v").mapInArrow(run, _FOUND)


def calibrate(rows: DataFrame, postings: DataFrame, graph: CentroidGraph, n: int, dim: int, k: int, recall: float = RECALL, sample: int = CALIBRATION_ROWS) -> tuple[int, float] | None:
    """(lists, distance ratio) that find ``recall`` of the ``k`` nearest of about ``sample`` stored vectors.

    The vectors, chosen by a hash of their ids, are searched exactly; for every neighbour the rank
    and ratio of the nearest list that holds it are known from the index. None where half of all lists
    or more would have to be read: an exact search is cheaper then.
    """
    chosen = rows.filter(hash_share(F.col("vec_id"), sample, n)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).collect()
    asked = list({r["vec_id"]: (r["vec_id"], r["v"]) for r in chosen}.values())
    if not asked:
        return None
    truth = _ranked(exact_search(rows, asked, dim, k), k).select("query_id", "vec_id").toArrow()  # 2 * sample * k rows at most
    if not len(truth):
        return None
    near = rows.sparkSession.createDataFrame([(i,) for i in sorted(set(truth.column("vec_id").to_pylist()))], "vec_id long")
    held: dict[int, list[int]] = {}
    for r in postings.select("list", "vec_id").join(F.broadcast(near), "vec_id").distinct().collect():
        held.setdefault(r["vec_id"], []).append(r["list"])
    place = {q: i for i, (q, _) in enumerate(asked)}
    d = _distances(np.array([v for _, v in asked], float).reshape(-1, dim), graph.centroids)
    rank = d.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") + 1
    needed, ratio = [], []
    for q, v in zip(truth.column("query_id").to_pylist(), truth.column("vec_id").to_pylist()):
        i = place[q]
        best = min(held[v], key=lambda c: rank[i, c])
        needed.append(int(rank[i, best]))
        ratio.append(d[i, best] / max(d[i].min(), 1e-300))
    needed, ratio = np.array(needed), np.array(ratio)
    most = int(np.sort(needed)[int(np.ceil(recall * len(needed))) - 1])
    if most * 2 >= len(graph.centroids):
        return None
    read = np.sort(ratio[needed <= most])
    return max(most, MIN_PROBES), float(read[int(np.ceil(0.995 * len(read))) - 1]) * (1 + 1e-9)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column | str, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, sample_rows: int = SAMPLE_ROWS,
           per_centroid: int = PER_CENTROID, closure: float = CLOSURE, prune: float | None = None, min_probes: int = MIN_PROBES, probes: int | None = None, recall: float = RECALL,
           list_rows: int = LIST_ROWS, list_queries: int = LIST_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every query row; ``is_query``
    is a condition on the column vec_id. How many lists a query reads is measured for ``recall``
    (:func:`calibrate`), unless ``prune`` or ``probes`` fixes it."""
    rows, n, dim = usable(vectors, id_col, vector_col)
    if not n:
        return _ranked(rows.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k)
    fitted = fit(rows, n, sample_rows=sample_rows, per_centroid=per_centroid)
    graph = rows.sparkSession.sparkContext.broadcast(fitted)
    postings = materialize(_entries(rows, graph, dim, closure, 1, REPLICAS, ROW_BEAM), "postings")
    asked = rows.filter(is_query)
    reads = (probes or PROBES, prune or PRUNE) if prune or probes else calibrate(rows, postings, fitted, n, dim, k, recall)
    if reads is None:
        found = _exact_blocks(rows, _one_each(asked), dim, k)
        return _ranked(rows.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")) if found is None else found, k)
    most, ratio = reads
    queries = materialize(_entries(asked, graph, dim, ratio, min(min_probes, most), most, max(QUERY_BEAM, most)), "queries")
    found = materialize(_ranked(_search_lists(postings, queries, dim, k, list_rows, list_queries), k), "nearest")
    # Queries whose lists held too few rows: all rows, in blocks of queries.
    short = _one_each(asked).join(found.groupBy("query_id").count().filter(F.col("count") >= min(k, max(n - 1, 0))), "query_id", "left_anti")
    more = _exact_blocks(rows, short, dim, k)
    return found if more is None else _ranked(found.select("query_id", "vec_id", "score").unionByName(more), k)


def _one_each(asked: DataFrame) -> DataFrame:
    return asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.first("v").alias("v"))


def _exact_blocks(rows: DataFrame, queries: DataFrame, dim: int, k: int, block_rows: int = 1024) -> DataFrame | None:
    """The exact search of a table of queries, about ``block_rows`` of them at a time; None without any."""
    queries = materialize(queries, "short")
    blocks, found = -(-queries.count() // block_rows), None
    for block in range(blocks):
        part = [(r["query_id"], r["v"]) for r in queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()]
        near = exact_search(rows, part, dim, k)
        found = near if found is None else found.unionByName(near)
    return found
