"""Spark session factory and the two helpers every plan shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays under these bounds.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def get_spark(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on; cluster settings stay with spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local master writes below its own ``spark.local.dir`` (there is one
    machine only); any other master must name a folder that all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if re.fullmatch(r"local(\[[^\]]*\])?", master):
        return f"file:{spark.conf.get('spark.local.dir', '/tmp').split(',')[0]}/shelfspark-{spark.sparkContext.applicationId}"
    raise ValueError(f"spark.checkpoint.dir is not set; with master {master} intermediate tables need a folder that all executors share")


def drop_written(spark: SparkSession) -> bool:
    """Delete the intermediate tables that :func:`materialize` wrote below the session's folder.

    Call it when nothing reads them any more; results of plans that were built on them do."""
    from shelfspark.sources.files import delete
    return delete(spark, f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in a columnar form that survives executor loss and still
    allows column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, bytes_per_row: int = 256) -> DataFrame:
    """Broadcast ``df`` when ``rows`` (measured by the caller) proves it small."""
    if rows <= BROADCAST_MAX_ROWS and rows * bytes_per_row <= BROADCAST_MAX_BYTES:
        return F.broadcast(df)
    return df


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fill(template: str, **values: Column) -> Column:
    """A text template with its ``{name}`` places filled by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def explode_once(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """Explode a computed array without computing it twice.

    A plain ``explode`` gets a size filter pushed below it, which repeats the array
    expression; the outer form does not, and its placeholder row is dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def any_of(column: Column, needles, *, fn=None) -> Column:
    """True when the text contains at least one of the literal strings."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | (fn(needle) if fn else column.contains(needle))
    return hit
