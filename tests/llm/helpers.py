"""Small tables and checks that all operator tests share."""

import random

TEXT_EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "a "), (9005, "z " * 20_000), (9006, "x" * 70_000)]


def documents(spark, rows, partitions=3):
    """Rows (doc_id, text) with further columns whose names clash with those of the results."""
    extra = [(i, t, "en", 1, 2, "k") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, n_tokens long, score int, spans string").repartition(partitions)


def vocabulary(n):
    return [f"w{k}" for k in range(n)]


def sentence(rng: random.Random, words, lo, hi):
    return " ".join(rng.choice(words) for _ in range(rng.randrange(lo, hi)))
