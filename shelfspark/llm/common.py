"""Helpers that several of the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import materialize

__all__ = ["materialize", "table", "held_out", "hash_share", "class_weights", "labelled_sample", "texts_of", "mix64", "csr_gather"]


#: Bytes of the Arrow batches that tasks hand to Python: a task holds one of them, not 64 MB.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table with only the named columns, read through Spark's file system."""
    small_batches(spark)
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def texts_of(batch: pa.RecordBatch, column: str = "text"):
    """The texts of an Arrow batch one at a time (a batch is never turned into one long list)."""
    for value in batch.column(column):
        yield value.as_py()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer (the finaliser of splitmix64) over an array of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def csr_gather(index: np.ndarray, start: np.ndarray, length: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``concatenate(values[start[i] : start[i] + length[i]] for i in index)`` without a loop."""
    n = length[index]
    total = int(n.sum())
    if not total:
        return values[:0]
    shift = start[index] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(total)]


def hash_share(id_col: Column, wanted: int, there: int) -> Column:
    """Rows whose ids hash into a share of the range that is expected to hold ``wanted`` of
    ``there`` rows (all of them, if there are no more). The choice needs no sort and is the same
    on every run; its size stays within a few times the square root of ``wanted`` of it."""
    if there <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(id_col), F.lit(1 << 31)) < int((1 << 31) * wanted / there)


def _chosen(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, label) of all labelled training rows, and of those chosen for the sample."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")).filter("label IN (0, 1)"))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    wanted = F.lit(False)
    for value, there in sorted(size.items()):
        wanted = wanted | ((F.col("label") == value) & hash_share(F.col("doc_id"), per_class, there))
    return known, known.filter(wanted)


def class_weights(labels: DataFrame, label: str, per_class: int) -> dict[int, float]:
    """For either class, how many labelled training rows one row of :func:`labelled_sample` stands for."""
    known, chosen = ({r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} for rows in _chosen(labels, label, per_class))
    return {value: known[value] / n for value, n in chosen.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of about ``per_class`` labelled training rows of either class.

    The rows are chosen by a hash of their ids. The chosen ids, bounded by the parameter, go to
    the scan as a broadcast; no text is shuffled. Rows of the held-out fold, null labels and
    other values are left out.
    """
    _, chosen = _chosen(labels, label, per_class)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
