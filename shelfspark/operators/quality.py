"""Fill rates, distributions and corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.text import nonblank, strip


def is_filled(field: str) -> Column:
    v = F.col(field).cast("string")
    if field == "summary":
        return F.coalesce(F.length(strip(v)) >= V.SUMMARY_FILLED_CHARS, F.lit(False))
    return nonblank(v).isNotNull()


def _unpivot(row: DataFrame, fields, make) -> DataFrame:
    """One-row aggregate -> one row per field."""
    return row.select(F.explode(F.array(*[make(f) for f in fields])).alias("r")).select("r.*")


def fill_rate(df: DataFrame, fields=tuple(V.FILLABLE_FIELDS)) -> DataFrame:
    """(field, filled, total, pct) from one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(is_filled(f).cast("long")).alias(f) for f in fields])
    return _unpivot(row, fields, lambda f: F.struct(
        F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("_n").alias("total"),
        F.round(F.col(f) * 100.0 / F.col("_n"), 1).alias("pct")))


def before_after(df: DataFrame, fields=tuple(V.REPORT_FIELDS), by: str = "ai_filled") -> DataFrame:
    """Fill rate without and with the values that enrichment added."""
    added = F.split(F.coalesce(F.col(by), F.lit("")), ",")
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(is_filled(f).cast("long")).alias(f) for f in fields],
                 *[F.sum((is_filled(f) & F.array_contains(added, f)).cast("long")).alias(f"_ai_{f}") for f in fields])
    return _unpivot(row, fields, lambda f: F.struct(
        F.lit(f).alias("field"), (F.col(f) - F.col(f"_ai_{f}")).alias("before"), F.col(f).alias("after"),
        F.col(f"_ai_{f}").alias("added"),
        F.round((F.col(f) - F.col(f"_ai_{f}")) * 100.0 / F.col("_n"), 1).alias("before_pct"),
        F.round(F.col(f) * 100.0 / F.col("_n"), 1).alias("after_pct")))


def length_bucket(wc: Column) -> Column:
    return (F.when(wc < 50, F.lit("<50")).when(wc < 200, F.lit("50-200"))
            .when(wc < 500, F.lit("200-500")).otherwise(F.lit(">500")))


def length_histogram(df: DataFrame, wc: Column) -> DataFrame:
    return df.groupBy(length_bucket(wc).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def overview(df: DataFrame, wc: Column, kind: str) -> DataFrame:
    """Documents and mean, longest, shortest and total words, overall and per kind."""
    w = df.select(kind, wc.alias("wc")).groupingSets([[], [kind]], kind)
    return w.agg(F.count(F.lit(1)).alias("n_docs"), F.floor(F.avg("wc")).cast("long").alias("avg_words"),
                 F.max("wc").alias("max_words"), F.min("wc").alias("min_words"), F.sum("wc").alias("total_words")
                 ).withColumn(kind, F.coalesce(kind, F.lit("ALL")))


def description_quality(df: DataFrame, text: Column, min_chars: int = 50) -> DataFrame:
    """Rows with a usable description, their share and mean length."""
    size = F.length(F.coalesce(text, F.lit("")))
    ok = size >= min_chars
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum(ok.cast("long")).alias("has_desc"),
                  F.sum((~ok).cast("long")).alias("no_desc"),
                  F.round(F.avg(ok.cast("int")) * 100, 1).alias("has_pct"),
                  F.round(F.coalesce(F.avg(F.when(ok, size)), F.lit(0.0)), 2).alias("avg_len"))


def short_and_empty(df: DataFrame, text: str, kind: str, short_bytes: int = 500) -> DataFrame:
    """Per kind: rows, rows below a byte size, rows without content."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"),
                                F.sum((F.octet_length(t) < short_bytes).cast("long")).alias("too_short"),
                                F.sum((t == "").cast("long")).alias("empty_content"))


def progress_total(df: DataFrame, progress: str, *keys: str) -> DataFrame:
    """Sum over the values of a JSON progress map."""
    entries = df.select(*keys, F.explode(F.map_values(F.from_json(progress, "map<string,bigint>"))).alias("v"))
    return entries.groupBy(*keys).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
