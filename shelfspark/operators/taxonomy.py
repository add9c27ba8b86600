"""Walking a category tree down to a fixed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import materialize


def walk(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, category, depth) of every category within ``depth`` steps, each once per root.

    ``edges(parent, child)``, ``roots(root)``. Each level is written once and read by the
    next ones, so the work grows with the depth and not with its square; a category already
    visited is dropped by an anti-join against the levels written so far.
    """
    level = roots.select("root", F.col("root").alias("category")).distinct()
    seen = level.withColumn("depth", F.lit(0).cast("long"))
    for d in range(1, depth + 1):
        level = materialize(level.join(edges, level["category"] == edges["parent"]).select("root", F.col("child").alias("category")).distinct()
                            .join(seen.select("root", "category"), ["root", "category"], "left_anti"), "level")
        seen = seen.unionByName(level.withColumn("depth", F.lit(d).cast("long")))
    return seen


def pages_under(categories: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pages of the visited categories with the shallowest depth; ``members(category, page_id)``."""
    return (categories.join(members, "category").groupBy("root", "page_id")
            .agg(F.min("depth").alias("depth")))
