"""Deduplication, upserts, anti-join resume, top-k and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_key(df: DataFrame, keys: list, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key with their 0-based rank.

    ``row_number() <= k`` lets Spark cut every task's rows per key to ``k`` before the
    shuffle (WindowGroupLimit), so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
            .withColumn(rank, (F.col(rank) - 1).cast("long")))


def keep_first(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def keep_longest(df: DataFrame, keys: list, text: str, *position: str | Column) -> DataFrame:
    """One row per key: the longest text, the earliest row on ties."""
    return keep_first(df, keys, [F.length(F.coalesce(F.col(text), F.lit(""))).desc(), *[F.col(p) if isinstance(p, str) else p for p in position]])


def title_author_key(title: str = "title", author: str = "author") -> list[Column]:
    from shelfspark.functions.text import strip
    return [F.lower(strip(F.coalesce(F.col(c), F.lit("")))) for c in (title, author)]


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Rows of both sides, the last write per key winning.

    With a ``version`` the highest one wins wherever it stands, so an older write that arrives
    late changes nothing; of equal versions, and without any, the update wins. What is still
    equal is settled by the whole row. The winner is found with a partial aggregate
    (``max_by``), so repeated writes of a hot key collapse before the shuffle.
    """
    both = base.withColumn("_gen", F.lit(0)).unionByName(updates.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("_gen", key)]
    order = ([F.col(version)] if version else []) + [F.col("_gen"), F.xxhash64(*cols)]
    picked = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in cols])


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: rows whose key is not in ``done`` yet."""
    return df.join(done.select(key), key, "left_anti")


def already_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_semi")


def share_by(df: DataFrame, *keys: str, decimals: int = 1) -> DataFrame:
    """Row count and percentage per key; the total comes from the counts, not a second scan."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, decimals))


def most_common(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties in key order."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(key)).limit(n))


def order_preserving_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)
