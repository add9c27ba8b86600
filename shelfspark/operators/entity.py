"""Merging the records of several sources into one entity per work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.functions.fold import author_key, norm_title
from shelfspark.functions.ids import uuid5
from shelfspark.functions.extract import classify_entity
from shelfspark.functions.text import nonblank, strip, word_count
from shelfspark.session import fill, materialize, small_side

#: Columns a source record may carry; missing ones are added as null.
RECORD_FIELDS = {
    "title": "string", "author": "string", "authors": "array<string>", "source": "string", "url": "string",
    "content": "string", "summary": "string", "ai_summary": "string", "description": "string",
    "genre": "string", "genres": "array<string>", "categories": "array<string>", "publisher": "string",
    "publication_year": "string", "word_count": "long", "page_count": "string", "isbn": "string",
    "isbn_list": "array<string>", "cover_url": "string", "name": "string", "folder": "string", "path": "string", "record_id": "string",
}


def with_record_fields(df: DataFrame) -> DataFrame:
    """All record columns; a record without an id of its own is known by its path."""
    missing = {n: F.lit(None).cast(t) for n, t in RECORD_FIELDS.items() if n not in df.columns}
    df = df.withColumns(missing) if missing else df
    return df.withColumn("record_id", F.coalesce("record_id", "path"))


def first_filled(*candidates: Column) -> Column:
    """First non-blank candidate, '' when there is none."""
    return F.coalesce(*[nonblank(c) for c in candidates], F.lit(""))


def first_item(name: str) -> Column:
    return F.get(F.col(name), F.lit(0))


def detect_source(folder: Column, url: Column, source: Column, *, by_url: bool) -> Column:
    """Source name from the folder a record was read from, its address, or its own field."""
    wiki = folder.contains("work")
    if by_url:
        wiki = wiki | F.coalesce(url, F.lit("")).contains("wikipedia") | folder.contains("author") | folder.contains("concept")
    return (F.when(folder.contains("archive"), F.lit("archive_compact"))
            .when(folder.contains("gbooks"), F.lit("gbooks"))
            .when(wiki, F.lit("wikipedia")).otherwise(F.coalesce(source, F.lit("unknown"))))


# ------------------------------------------------------------------ index entities
def merge_entities(records: DataFrame, *, use_gbooks_text: bool = True) -> DataFrame:
    """One row per (normalised title, sorted author tokens), its sources resolved.

    A group without author joins the single authored group of the same title; with two
    or more such groups it stays alone. Every step is a partial aggregate or an
    equi-join on a key, so a title shared by a third of all rows is reduced in the map
    tasks. ``use_gbooks_text`` lets books known from one catalogue only keep their text.
    """
    r = with_record_fields(records)
    title = first_filled(F.col("title"), F.col("name"))
    author = first_filled(F.col("author"), first_item("authors"))
    src = detect_source(F.col("folder"), F.col("url"), F.col("source"), by_url=True)
    r = (r.withColumn("title", title).filter(F.col("title") != "").withColumn("author", author)
         .withColumn("source", src).withColumn("norm_title", norm_title("title")))
    r = r.withColumn("key", F.concat("norm_title", F.lit(" | "), author_key("author")))

    # Winners are picked on ids, short fields and whether there is a text; the texts stay behind.
    texts = {"wikipedia": ["description", "content"], "archive_compact": ["content"],
             "gbooks": ["description"] + (["summary", "content"] if use_gbooks_text else [])}
    own_text = F.lit(None).cast("string")
    for name, fields in texts.items():
        own_text = F.when(F.col("source") == name, F.coalesce(*[F.nullif(f, F.lit("")) for f in fields])).otherwise(own_text)
    r = r.withColumn("own_text", own_text)
    payload = F.struct("title", "author", "ai_summary", "genre", "genres", "categories", "publisher", "publication_year", "word_count",
                       "record_id", F.col("own_text").isNotNull().alias("told"))
    by_source = r.groupBy("key", "norm_title", "source").agg(
        F.max_by(payload, "record_id").alias("doc"), F.min("record_id").alias("first_path"),
        F.min_by(F.struct("title", "author"), "record_id").alias("name"), F.count(F.lit(1)).alias("n_paths"))

    groups = by_source.groupBy("key", "norm_title").agg(
        F.min_by("name", "first_path").alias("name"), F.min("first_path").alias("first_path"))
    authored = groups.filter(F.col("name.author") != "")
    single = (authored.groupBy("norm_title").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("target"))
              .filter(F.col("n") == 1).select("norm_title", "target"))
    orphans = groups.filter(F.col("name.author") == "").select("key", "norm_title")
    moves = orphans.join(single, "norm_title").select("key", "target")

    placed = by_source.join(moves, "key", "left").select(
        F.coalesce("target", "key").alias("key"), F.col("target").isNotNull().alias("moved"),
        "source", "doc", "first_path", "name", "n_paths")
    one = placed.groupBy("key", "source").agg(
        F.min_by("doc", F.struct("moved", "first_path")).alias("doc"),
        F.min_by("name", F.struct("moved", "first_path")).alias("name"),
        F.min(F.struct("moved", "first_path")).alias("order"), F.sum("n_paths").alias("n_paths"))

    of = lambda s: F.max(F.when(F.col("source") == s, F.col("doc")))
    prio = F.array_position(F.lit(V.SOURCE_PRIORITY), F.col("source"))
    prio = F.when(prio == 0, F.lit(99)).otherwise(prio)
    pick = lambda field: F.min(F.when(nonblank(F.col("doc")[field]).isNotNull(),
                                      F.struct(prio.alias("p"), F.col("source").alias("s"), strip(F.col("doc")[field]).alias("v"))))
    wide = one.groupBy("key").agg(
        F.min_by("name", "order").alias("name"), of("wikipedia").alias("w"), of("gbooks").alias("g"),
        of("archive_compact").alias("a"), pick("publication_year").alias("year"),
        pick("publisher").alias("publisher"), pick("genre").alias("genre"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.sum("n_paths").alias("n_paths"))

    ai = F.coalesce(F.col("a.ai_summary"), F.lit(""))
    of_source = lambda s: F.when(F.col(f"{s}.told"), F.col(f"{s}.record_id"))
    wide = materialize(wide.withColumn("text_of", F.coalesce(of_source("w"), of_source("g"), F.when(ai == "", of_source("a")))), "entities")
    chosen = wide.filter("text_of IS NOT NULL").select(F.col("text_of").alias("record_id")).distinct()
    chosen = r.select("record_id", "own_text").join(small_side(chosen, wide.count(), 96), "record_id").groupBy("record_id").agg(F.max("own_text").alias("own_text"))
    wide = wide.join(chosen.withColumnRenamed("record_id", "text_of"), "text_of", "left")
    genre = F.coalesce(F.col("genre.v"), F.lit(""))
    book_genres = F.coalesce(F.col("g.categories"), F.col("g.genres"), F.array().cast("array<string>"))
    genres = F.when(F.size(book_genres) > 0, book_genres).when(genre != "", F.array(genre)).otherwise(F.array().cast("array<string>"))
    return wide.select(
        uuid5("key").alias("id"), "key", F.col("name.title").alias("title"),
        first_filled(F.col("w.author"), F.col("a.author"), F.col("g.author"), F.col("name.author")).alias("author"),
        F.coalesce("year.v", F.lit("")).alias("year"), genres.alias("genres"), genre.alias("genre"),
        F.coalesce("publisher.v", F.lit("")).alias("publisher"), F.col("a.word_count").alias("archive_words"),
        ai.alias("ai_summary"),
        F.coalesce(strip(F.coalesce("own_text", ai)), F.lit("")).alias("summary"),
        F.array_join("sources", ", ").alias("source"), "n_paths",
    ).filter(F.col("summary") != "")


def inject_metadata(entities: DataFrame) -> DataFrame:
    """One chunk per entity: bracketed header, optional generated summary, body; cut when long."""
    tag = lambda template, c: F.when(c != "", fill(template, v=c))
    words = F.when(F.coalesce(F.col("archive_words"), F.lit(0)) != 0, fill(V.HEADER_LENGTH, v=F.col("archive_words").cast("string")))
    header = F.concat_ws(" | ", fill(V.HEADER_TITLE, v=F.col("title")), tag(V.HEADER_AUTHOR, F.col("author")), tag(V.HEADER_YEAR, F.col("year")),
                         tag(V.HEADER_GENRE, F.array_join("genres", ", ")), tag(V.HEADER_PUBLISHER, F.col("publisher")), words)
    extra = F.when((F.col("ai_summary") != "") & ~F.col("summary").contains(F.col("ai_summary")),
                   fill(V.HEADER_AI_SUMMARY, v=F.col("ai_summary"))).otherwise(F.lit(""))
    full = F.concat(header, F.lit("\n\n"), extra, F.lit(f"{V.DETAIL_MARKER}\n"), "summary")
    out = entities.withColumn("text", full).withColumn("text", F.when(
        F.length("text") > V.ENTITY_TEXT_CHARS, F.concat(F.substring("text", 1, V.ENTITY_TEXT_CHARS), F.lit("..."))).otherwise(F.col("text")))
    return out.select(
        F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), "text", F.lit(0).cast("long").alias("start_word"),
        word_count("text").alias("end_word"), word_count("text").alias("word_count"),
        F.length("text").cast("long").alias("char_count"), F.lit("metadata_injection").alias("strategy"),
        "title", "author", "year",
        F.when(F.col("genre") != "", F.col("genre")).otherwise(F.coalesce(F.get("genres", F.lit(0)), F.lit(""))).alias("genre"),
        "publisher", "source")


# ------------------------------------------------------------------ export catalogue
def catalogue_records(records: DataFrame) -> DataFrame:
    """Source records with their catalogue key and id."""
    r = with_record_fields(records)
    r = (r.withColumn("title", first_filled(F.col("title"), F.col("name"))).filter(F.col("title") != "")
         .withColumn("author", first_filled(F.col("author"), first_item("authors")))
         .withColumn("source", detect_source(F.col("folder"), F.col("url"), F.col("source"), by_url=False)))
    return r.withColumn("key", F.concat(F.lower("title"), F.lit(" | "), F.lower("author")))


def catalogue(records: DataFrame) -> DataFrame:
    """One metadata row per (title, author): first filled value per column in the order of the
    record ids, longest summary, person flag, sorted sources.

    Only aggregates with partial results are used, over short fields; which records belong to a row is told in
    long form by :func:`entity_paths`, however many they are.
    """
    r = catalogue_records(records)
    first = lambda c: F.coalesce(F.min_by(c, F.when(c.isNotNull(), F.col("record_id"))), F.lit(""))
    filled = {
        "publication_year": nonblank("publication_year"),
        "genre": F.coalesce(nonblank("genre"), nonblank(first_item("genres"))),
        "publisher": nonblank("publisher"),
        "page_count": F.nullif(nonblank("page_count"), F.lit("0")),
        "isbn": F.coalesce(nonblank("isbn"), nonblank(first_item("isbn_list"))),
        "cover_url": nonblank("cover_url"),
    }
    texts = F.array(*[F.coalesce(strip(c), F.lit("")) for c in ("summary", "ai_summary", "description")])
    longest = F.aggregate(texts, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    r = r.withColumns({f"_{n}": c for n, c in filled.items()}).withColumn("_summary", longest)
    g = r.groupBy("key").agg(
        F.min_by(F.struct("title", "author"), "record_id").alias("name"),
        F.max((classify_entity("categories", "summary") == "author").cast("int")).alias("person"),
        *[first(F.col(f"_{n}")).alias(n) for n in filled],
        F.min(F.struct((-F.length("_summary")).alias("l"), F.col("record_id").alias("r"))).alias("best"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.min("record_id").alias("first_record"), F.count(F.lit(1)).alias("n_paths"))
    # The longest text is picked by length and record; only the chosen ones are read again and sent.
    g = materialize(g, "catalogue")
    chosen = small_side(g.select(F.col("key").alias("_key"), F.col("best.r").alias("_record"), F.col("best.l").alias("_l")), g.count(), 160)
    told = (r.select("key", "record_id", "_summary").join(chosen, (F.col("key") == F.col("_key")) & (F.col("record_id") == F.col("_record")) & (-F.length("_summary") == F.col("_l")))
            .groupBy("key").agg(F.min("_summary").alias("_told")))
    g = g.join(told, "key")
    return g.select(
        uuid5("key").alias("id"), F.col("name.title").alias("title"),
        F.when(F.col("person") == 1, "author").otherwise("work").alias("entity_type"),
        F.col("name.author").alias("author"), *filled, F.col("_told").alias("summary"),
        F.array_join("sources", ", ").alias("source"), "first_record", "n_paths")


def entity_paths(records: DataFrame) -> DataFrame:
    """(id, record_id, path): which record belongs to which entity."""
    return catalogue_records(records).select(uuid5("key").alias("id"), "record_id", "path")
