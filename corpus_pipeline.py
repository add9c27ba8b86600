"""A corpus made ready for training in five stages.

Toxic documents go; one document of each group of near duplicates stays (the smallest id);
documents that hold a benchmark passage go; personal data is masked; what is left is encoded.

Every stage takes all that its predecessor kept, written as Parquet and read again, and returns
the columns of ``documents`` (further columns are passed on), the last one the encoded rows.
Null and empty texts pass all filters; repeated rows count as copies; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import materialize, small_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learnt from the labelled rows rejects go."""
    from shelfspark.llm.toxicity import drop_toxic, fit
    small_batches(spark)
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    from shelfspark.llm.jaccard_join import keep_one
    small_batches(spark)
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    from shelfspark.llm.decontamination import drop_contaminated
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text."""
    from shelfspark.llm.pii import mask_pii
    masked = docs.withColumn("text", mask_pii(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every document left."""
    import public_tokenizers

    from shelfspark.llm.bpe import encode_decode
    small_batches(spark)
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), full=True).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("bpe", bpe),
]
#: Learnt scores, similarity groups and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
