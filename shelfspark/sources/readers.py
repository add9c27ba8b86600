"""Readers for the raw record folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.text import strip

ARTICLE_SCHEMA = (
    "id string, title string, url string, category string, categories array<string>, summary string, "
    "content string, crawled_at string, last_modified string, language string, word_count int, is_valid boolean")
BOOK_SCHEMA = (
    "id string, title string, url string, wikidata_id string, summary string, content string, author string, "
    "authors array<string>, publication_year string, genre string, genres array<string>, isbn string, "
    "isbn_list array<string>, publisher string, page_count int, cover_url string, source string, "
    "author_source string, year_source string, genre_source string, crawl_category string, "
    "categories array<string>, language string, word_count int, char_count int, crawled_at string, "
    "last_modified string")
PERSON_SCHEMA = (
    "id string, title string, url string, wikidata_id string, summary string, content string, birth_year string, "
    "death_year string, nationality string, notable_works array<string>, genres array<string>, "
    "birth_source string, nationality_source string, crawl_category string, categories array<string>, "
    "language string, word_count int, char_count int, crawled_at string, last_modified string")
RECORD_SCHEMA = (
    "id string, title string, name string, type string, url string, author string, authors array<string>, "
    "source string, content string, summary string, ai_summary string, description string, genre string, "
    "genres array<string>, categories array<string>, publisher string, publication_year string, page_count string, "
    "isbn string, isbn_list array<string>, cover_url string, word_count long, char_count long, language string")
METADATA_COLUMNS = [*V.CATALOG_COLUMNS, "ai_filled"]


def _pieces(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """(path, position, several, record): every JSON value of every file, parsed; null where unreadable.

    A file may hold one record, a list of records, or several records one after the other.
    """
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\\A\ufeff", "").alias("value")))
    roots = F.split("value", r"(?<=\})\s*\n\s*(?=\{)")
    values = files.select("path", F.posexplode(roots).alias("root", "value"))
    parsed = values.withColumn("records", F.from_json("value", f"array<struct<{schema}>>"))
    return (parsed.select("path", "root", F.posexplode_outer("records").alias("item", "record"))
            .withColumn("position", F.col("root") + F.coalesce("item", F.lit(0))))


def read_json_folder(spark: SparkSession, path: str, schema: str, pattern: str = "*.json",
                     limit: int | None = None) -> DataFrame:
    """All records of a raw folder, any depth. Unreadable records are dropped; ``path``, ``folder``
    and ``record_id`` (the path, with the record's place where it is not the first) are added."""
    p = _pieces(spark, path, schema, pattern).filter(F.col("record").isNotNull())
    place = F.concat_ws("#", "root", "item")
    df = p.select("record.*", "path", F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("folder"),
                  F.when(F.col("position") == 0, F.col("path")).otherwise(F.concat_ws("#", "path", place)).alias("record_id"))
    return df.orderBy("record_id").limit(limit) if limit else df


def count_broken(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> int:
    return _pieces(spark, path, schema, pattern).filter(F.col("record").isNull()).count()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of one folder: the Parquet that the cleaning steps write, and raw JSON."""
    own = (spark.read.schema(f"{RECORD_SCHEMA}, path string, record_id string").option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.parquet").parquet(path))
    raw = read_json_folder(spark, path, RECORD_SCHEMA).drop("folder")
    return own.unionByName(raw.filter(~F.regexp_extract("path", r"([^/]+)\z", 1).contains("meta")), allowMissingColumns=True)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).schema  # noqa: B018
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def read_source_folders(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    """Union of several record folders; each may be named plainly or as a partition of a
    cleaning step (``type=work``, ``folder=work``). Every record has a ``record_id``."""
    out = None
    for name in folders:
        for place in (name, f"type={name}", f"folder={name}"):
            if _exists(spark, f"{base}/{place}"):
                df = read_records(spark, f"{base}/{place}").withColumn("folder", F.lit(name))
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"none of the folders {folders} is in {base}")
    return out


def title_author_of(file_stem) -> tuple:
    """'Title - Author' split at the last separator."""
    parts = lambda i: F.regexp_extract(file_stem, r"(?s)\A(.*) - (.*)\z", i)
    split = file_stem.contains(" - ")
    return (strip(F.when(split, parts(1)).otherwise(file_stem)),
            strip(F.when(split, parts(2)).otherwise(F.lit(V.UNKNOWN_FILE_AUTHOR))))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files; the name is data. Undecodable bytes are dropped."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)\.txt\z", 1))
    title, author = title_author_of(F.col("_stem"))
    return (df.select("path", name.alias("_stem"), strip(text).alias("content"))
            .select("path", title.alias("title"), author.alias("author"), "content"))


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata table with byte-order mark, quoted newlines and doubled quotes."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in METADATA_COLUMNS])


def read_links(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, record_id) of an exported catalogue; None where it was written without."""
    return spark.read.parquet(path).select("id", "record_id") if _exists(spark, path) else None


def read_vectors(spark: SparkSession, vectors: str, payload: str, key: str = "id", payload_table: DataFrame | None = None) -> DataFrame:
    """Vector table with its payload; every vector must have exactly one payload."""
    v, p = spark.read.parquet(vectors), payload_table if payload_table is not None else spark.read.parquet(payload)
    sides = v.select(key, F.lit(1).alias("v"), F.lit(0).alias("p")).unionByName(p.select(key, F.lit(0).alias("v"), F.lit(1).alias("p")))
    odd = sides.groupBy(key).agg(F.sum("v").alias("v"), F.sum("p").alias("p")).filter((F.col("v") != 1) | (F.col("p") != 1))
    n = odd.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p") == 0, 1)).alias("bare"), F.count(F.when(F.col("v") == 0, 1)).alias("idle")).first()
    if n["n"]:
        raise ValueError(f"{n['n']} keys do not have one vector and one payload: {n['bare']} without payload, {n['idle']} without vector")
    return v.join(p, key)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of a stored index without its vectors."""
    return spark.read.parquet(path).drop("embedding")
