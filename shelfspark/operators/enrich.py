"""Filling empty metadata fields and writing them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.extract import clean_suggested_value
from shelfspark.functions.text import nonblank, strip

#: A suggester maps (title, author, summary) to ``map<field, value>``; none is built in.
Suggester = Callable[[Column, Column, Column], Column]


def missing_fields(fields=tuple(V.ENRICH_FIELDS)) -> Column:
    """Names of the blank fields of a row."""
    return F.array_compact(F.array(*[F.when(nonblank(F.col(f).cast("string")).isNull(), F.lit(f)) for f in fields]))


def needs_summary(summary: str = "ai_summary", genre: str = "genre") -> Column:
    s = F.coalesce(F.col(summary), F.lit(""))
    return (F.length(strip(s)) < V.SUMMARY_REDO_CHARS) | (F.coalesce(F.col(genre), F.lit("")) == "")


def enrich(rows: DataFrame, suggestions: Column | None = None, suggester: Suggester | None = None,
           fields=tuple(V.ENRICH_FIELDS)) -> DataFrame:
    """Fill blank fields from suggested values; ``ai_filled`` lists what was filled.

    Person pages and complete rows pass through unchanged.
    """
    ask = suggestions if suggestions is not None else suggester(F.col("title"), F.col("author"), F.col("summary"))
    df = rows.withColumn("_s", ask)
    open_row = F.coalesce(F.col("entity_type"), F.lit("work")) != "author"
    usable = {f: F.when(open_row & nonblank(F.col(f)).isNull(),
                        clean_suggested_value(F.lit(f), F.try_element_at("_s", F.lit(f)))) for f in fields}
    df = df.withColumns({f"_v_{f}": c for f, c in usable.items()})
    filled = F.array_compact(F.array(*[F.when(F.col(f"_v_{f}").isNotNull(), F.lit(f)) for f in fields]))
    df = df.withColumn("ai_filled", F.array_join(filled, ","))
    df = df.withColumns({f: F.coalesce(F.col(f"_v_{f}"), F.col(f)) for f in fields})
    return df.drop("_s", *[f"_v_{f}" for f in fields])


def explode_paths(rows: DataFrame, paths: str = "source_paths") -> DataFrame:
    """One row per source path of a metadata row, the path standing for the record."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(paths), F.lit("")), ";"), strip), lambda p: p != "")
    return rows.withColumn("record_id", F.explode(parts)).drop(paths)


def is_empty(c: Column) -> Column:
    s = c.cast("string")
    return nonblank(s).isNull() | (strip(s) == "0")


def write_back(docs: DataFrame, enriched: DataFrame, fields=tuple(V.ENRICH_FIELDS)) -> DataFrame:
    """Documents with their empty fields filled from the enriched row that names their record.

    ``changed`` lists the filled fields. Where several rows name one record, the first id
    with a value wins, as with one update after the other. A document without a
    ``record_id`` is known by its path.
    """
    if "record_id" not in docs.columns:
        docs = docs.withColumn("record_id", F.col("path"))
    rows = enriched.select("id", "record_id", *[nonblank(F.col(f).cast("string")).alias(f) for f in fields])
    per_record = rows.groupBy("record_id").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("id"))).alias(f"_n_{f}") for f in fields])
    df = docs.join(per_record, "record_id", "left")
    fill = {f: is_empty(F.col(f)) & F.col(f"_n_{f}").isNotNull() for f in fields}
    df = df.withColumn("changed", F.array_compact(F.array(*[F.when(fill[f], F.lit(f)) for f in fields])))
    df = df.withColumns({f: F.when(fill[f], F.col(f"_n_{f}")).otherwise(F.col(f).cast("string")) for f in fields})
    return df.drop(*[f"_n_{f}" for f in fields])


def write_back_summary(updated: DataFrame, fields=tuple(V.ENRICH_FIELDS)) -> DataFrame:
    return updated.agg(
        F.sum((F.size("changed") > 0).cast("long")).alias("files"), F.sum(F.size("changed")).cast("long").alias("fields_written"),
        *[F.sum(F.array_contains("changed", f).cast("long")).alias(f) for f in fields])


def original_text(cards: DataFrame, archive: DataFrame, name: str = "file_name") -> DataFrame:
    """Card joined to the full text of the same file; the card text where there is none."""
    full = archive.select(name, F.col("content").alias("_full"))
    return (cards.join(full, name, "left")
            .withColumn("full_text", F.coalesce(F.nullif("_full", F.lit("")), F.col("content"))).drop("_full"))
