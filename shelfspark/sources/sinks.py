"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.text import latex_percent, vn_number
from shelfspark.operators.keyed import top_per_key
from shelfspark.session import materialize
from shelfspark.sources import files


def write_records(df: DataFrame, path: str, by: str | None = None) -> None:
    """Records for the next step: Parquet with the columns and types of a record and a
    ``record_id`` (kept, or made from the content), in one folder per value of ``by``."""
    from shelfspark.sources.readers import RECORD_SCHEMA
    kinds = dict(f.strip().split(" ") for f in RECORD_SCHEMA.split(", "))
    keep = F.sha1(F.to_json(F.struct(*[c for c in df.columns if c != "record_id"])))
    own = F.coalesce(F.col("record_id"), keep) if "record_id" in df.columns else keep
    cols = [F.col(c).cast(kinds[c]) for c in kinds if c in df.columns and c != by]
    more = [F.col("path")] if "path" in df.columns else [own.alias("path")]
    out = df.select(*cols, *more, own.alias("record_id"), *([F.col(by)] if by else []))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json_by_type(df: DataFrame, path: str, by: str = "type") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_csv(df: DataFrame, path: str, columns=tuple(V.CATALOG_COLUMNS), mode: str = "overwrite", mark: bool = True) -> None:
    """CSV with a fixed column order; the files stay as many as there are tasks.

    ``mark`` starts each file with a byte-order mark, carried by the first column name.
    """
    first, *rest = columns
    named = df.select(F.col(first).alias(f"\ufeff{first}" if mark else first), *rest)
    (named.write.mode(mode).option("header", True).option("quoteAll", False)
     .option("escape", '"').option("encoding", "UTF-8").csv(path))


#: Parts of the key table of an append-once table.
KEY_BUCKETS = 64


def append_new(df: DataFrame, path: str, key: str = "id", buckets: int = KEY_BUCKETS) -> DataFrame:
    """Append the rows whose key is not stored yet and return what was added.

    The keys stand beside the rows in ``<path>/_keys``, in folders by key hash; a batch looks its own
    up in the folders that they fall into. The mark ``_pending`` stands while rows and keys
    are written: where it is found, a batch broke off, and the keys are taken from the rows again.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    there = files.names(spark, path)
    stored = any(n.endswith(".parquet") for n in there)
    if stored and ("_pending" in there or "_keys" not in there):
        _write_keys(spark.read.parquet(path).select(key, bucket.alias("key_bucket")), path, "overwrite")
    new = df
    if stored:
        touched = sorted(r[0] for r in df.select(bucket.alias("b")).distinct().collect())  # at most the number of buckets
        done = spark.read.parquet(f"{path}/_keys").filter(F.col("key_bucket").isin(touched)).select(F.col(key))
        new = df.join(done, key, "left_anti").select(*df.columns)
    files.write_text(spark, f"{path}/_pending", "")
    new = materialize(new, "new")  # the same rows go to the table and to the keys
    new.write.mode("append").parquet(path)
    _write_keys(new.select(key, bucket.alias("key_bucket")), path, "append" if stored else "overwrite")
    files.delete(spark, f"{path}/_pending")
    return new


def _write_keys(keys: DataFrame, path: str, mode: str) -> None:
    keys.repartition("key_bucket").write.mode(mode).partitionBy("key_bucket").parquet(f"{path}/_keys")


def run_stats(df: DataFrame, **counts) -> DataFrame:
    """One row of named conditional counts."""
    return df.agg(*[F.count(F.when(cond, 1)).alias(name) for name, cond in counts.items()])


def write_observed(df: DataFrame, path: str, mode: str = "append", **counts) -> dict:
    """Writes the rows and returns the named conditional counts, gathered by the tasks that write."""
    seen = Observation()
    df.observe(seen, *[F.count(F.when(cond, 1)).alias(name) for name, cond in counts.items()]).write.mode(mode).parquet(path)
    return seen.get


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def latex_fill_rows(before_after: DataFrame) -> DataFrame:
    """Table rows of the fill-rate report, Vietnamese number format."""
    cell = lambda c: F.concat(F.lit("$"), latex_percent(c), F.lit(r"\%$"))
    line = F.concat(F.replace(F.col("field"), F.lit("_"), F.lit(r"\_")), F.lit(" & "), cell("before_pct"), F.lit(" & "),
                    cell("after_pct"), F.lit(" & "), vn_number("added"), F.lit(r" \\"))
    return before_after.select("field", line.alias("latex"))


def sheet_rows(df: DataFrame) -> DataFrame:
    """Content of the per-type workbook sheets: preview and joined categories instead of the text."""
    return df.select(
        "id", "title", "type", "category", "word_count", "char_count",
        F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("summary_preview"),
        F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " | ").alias("categories_str"),
        "crawled_at", "last_modified", "url")


def type_sheets(df: DataFrame, n: int = 15) -> DataFrame:
    """(type, category, rank, articles, words, most_words, least_words): the ``n`` largest categories of every type
    and of all types (type null), and the totals of every type and of all (category null), in one pass."""
    sums = df.groupingSets([["type", "category"], ["type"], ["category"], []], "type", "category").agg(
        F.grouping_id("type", "category").cast("int").alias("level"), F.count(F.lit(1)).alias("articles"), F.sum("word_count").alias("words"),
        F.max("word_count").alias("most_words"), F.min("word_count").alias("least_words"))
    ranked = top_per_key(sums, ["level", F.when(F.col("level") % 2 == 0, F.col("type"))], [F.col("articles").desc(), F.col("category"), F.col("type")], n)
    whole = F.col("level") % 2 == 1
    kept = ranked.filter(~whole).unionByName(sums.filter(whole).withColumn("rank", F.lit(None).cast("long")))
    return kept.select("type", "category", "rank", "articles", "words", "most_words", "least_words")


def write_sheets(df: DataFrame, path: str) -> None:
    """The content of the sheets, one partition of the table per type, and their figures."""
    sheet_rows(df).write.mode("overwrite").partitionBy("type").parquet(f"{path}/sheets")
    type_sheets(df).write.mode("overwrite").parquet(f"{path}/overview")
