"""Cleaned records -> entities, chunks, index and vectors in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.operators.bm25 import LexicalIndex
from shelfspark.operators.entity import inject_metadata, merge_entities
from shelfspark.operators.vectors import Embedder, embed, hashing_embedder
from shelfspark.plans.search import Library
from shelfspark.sources.readers import read_source_folders

FOLDERS = ["author", "work", "gbooks", "archive_compact"]


def build(spark: SparkSession, processed: str, target: str, embedder: Embedder | None = None) -> DataFrame:
    """Full rebuild. Only the entity table, the vectors and the index are materialised."""
    chunks = inject_metadata(merge_entities(read_source_folders(spark, processed, FOLDERS)))
    chunks.write.mode("overwrite").parquet(f"{target}/entities")
    stored = spark.read.parquet(f"{target}/entities")
    vecs = embed(stored.select("doc_id", "text"), embedder or hashing_embedder(), "text").select("doc_id", "embedding")
    vecs.write.mode("overwrite").parquet(f"{target}/vectors")
    LexicalIndex.build(stored).save(f"{target}/index")
    return stored


def open_library(spark: SparkSession, target: str, embedder: Embedder | None = None) -> Library:
    return Library(spark.read.parquet(f"{target}/entities"), LexicalIndex.load(spark, f"{target}/index"),
                   spark.read.parquet(f"{target}/vectors"), embedder or hashing_embedder())
