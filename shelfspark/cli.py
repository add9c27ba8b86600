"""Command line: ``python -m shelfspark.cli <command> ...``

Folders may be local paths or any address Spark can read.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.config import EVAL_KS, ChunkConfig
from shelfspark.operators import canon, chunk, enrich, entity, evaluate, quality
from shelfspark.operators.bm25 import Queries
from shelfspark.plans import ingest, library_build
from shelfspark.plans.search import MODES
from shelfspark.session import get_spark
from shelfspark.sources import readers, sinks


#: Folders whose records the catalogue holds.
CATALOGUE_FOLDERS = ["work", "gbooks", "archive_compact"]


def _show(df: DataFrame, n: int = 100) -> None:
    df.show(n, truncate=120)


def clean_articles(spark: SparkSession, a) -> None:
    raw = readers.read_json_folder(spark, a.input, readers.ARTICLE_SCHEMA, "page_*.json", a.limit)
    out = ingest.clean_articles(raw)
    if a.stats:
        _show(out.groupBy("type").count())
    else:
        sinks.write_records(out, a.output, by="type")


def clean_books(spark: SparkSession, a) -> None:
    raw = readers.read_json_folder(spark, a.input, readers.BOOK_SCHEMA, "gbooks_*.json", a.limit)
    if a.stats or a.dry_run:
        _show(ingest.funnel(raw, filter_topic=not a.no_filter_topic))
        _show(quality.length_histogram(ingest.clean_books(raw, filter_topic=not a.no_filter_topic), F.col("word_count")))
    else:
        sinks.write_records(ingest.clean_books(raw, filter_topic=not a.no_filter_topic), a.output)


def clean_archive(spark: SparkSession, a) -> None:
    records = ingest.clean_archive(readers.read_texts(spark, a.input))
    sinks.write_records(ingest.book_cards(records) if a.cards else records, a.output)


def build_library(spark: SparkSession, a) -> None:
    print(f"{library_build.build(spark, a.input, a.output).count()} entities")


def search(spark: SparkSession, a) -> None:
    lib = library_build.open_library(spark, a.library)
    q = Queries.of(spark.createDataFrame([(0, a.query)], "query_id long, query string"))
    mode = "hybrid" if a.no_rerank and a.mode == "hybrid_rerank" else a.mode
    found = lib.compare(q, a.top_k) if a.compare else lib.search(q, a.top_k, mode).withColumn("mode", F.lit(mode))
    texts = lib.docs.select("doc_id", "title", "author", F.substring("text", 1, 120).alias("text"))
    _show(texts.join(q.small(found, a.top_k * len(MODES)), "doc_id").orderBy("mode", "rank").select("mode", "rank", "score", "title", "author", "text"))


def evaluate_search(spark: SparkSession, a) -> None:
    lib = library_build.open_library(spark, a.library)
    tests = spark.read.schema("query_id string, query string, query_type string, relevant_keywords array<string>").json(a.tests)
    tests = tests.withColumnRenamed("relevant_keywords", "keywords")
    if a.query_type:
        tests = tests.filter(F.col("query_type") == a.query_type)
    modes = [m for m in (a.mode or MODES) if not (a.no_rerank and m == "hybrid_rerank")]
    avg = evaluate.macro_average(lib.evaluate(tests, tuple(a.ks), modes))
    if a.output:
        sinks.write_report(evaluate.report_json(avg), a.output)
    _show(avg.orderBy("mode", "query_type", "k"))


def export_csv(spark: SparkSession, a) -> None:
    records = readers.read_source_folders(spark, a.input, CATALOGUE_FOLDERS)
    rows = entity.catalogue(records)
    sinks.write_csv(rows.withColumn("source_paths", F.lit(None).cast("string")), a.output)  # all of them are in -paths
    entity.entity_paths(records).write.mode("overwrite").parquet(f"{a.output}-paths")
    _show(quality.fill_rate(rows))


def import_csv(spark: SparkSession, a) -> None:
    """Dry run unless --apply; writes a new version of the records, never in place."""
    docs = readers.read_source_folders(spark, a.input, library_build.FOLDERS)
    rows = readers.read_metadata_csv(spark, a.csv)
    links = readers.read_links(spark, f"{a.csv}-paths")
    done = enrich.write_back(docs, enrich.explode_paths(rows) if links is None else rows.join(links, "id"))
    _show(enrich.write_back_summary(done))
    if a.apply:
        sinks.write_records(done, a.output, by="folder")


def report(spark: SparkSession, a) -> None:
    rows = readers.read_metadata_csv(spark, a.csv)
    from shelfspark.functions.extract import normalize_genre
    from shelfspark.operators.keyed import most_common
    stats = quality.before_after(rows)
    _show(stats)
    works = rows.filter((F.coalesce("entity_type", F.lit("work")) == "work") & quality.is_filled("genre"))
    _show(most_common(works.withColumn("genre", normalize_genre("genre")), "genre", a.top))
    _show(sinks.latex_fill_rows(stats))


def audit(spark: SparkSession, a) -> None:
    lib = library_build.open_library(spark, a.library)
    expected = spark.read.schema("canon_id long, title string, author string").json(a.canon)
    entries = lib.docs.withColumn("position", F.col("doc_id"))
    matches = canon.match_titles(expected, entries)
    _show(canon.coverage_summary(matches, canon.quality_flags(entries)))
    _show(expected.join(matches, "canon_id").filter(F.col("how") == "missing"))


def chunk_report(spark: SparkSession, a) -> None:
    docs = spark.read.parquet(a.input)
    _show(chunk.strategy_stats(docs, ChunkConfig(a.size, a.overlap, a.stride), text=a.text))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfspark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for flags, kw in options:
            s.add_argument(*flags, **kw)

    opt = lambda *flags, **kw: (flags, kw)
    io = (opt("input"), opt("output"))
    flag = lambda name: opt(name, action="store_true")
    add("clean-articles", clean_articles, *io, opt("--limit", type=int), flag("--stats"))
    add("clean-books", clean_books, *io, opt("--limit", type=int), flag("--stats"), flag("--dry-run"), flag("--no-filter-topic"))
    add("clean-archive", clean_archive, *io, flag("--cards"))
    add("build", build_library, *io)
    add("search", search, opt("library"), opt("query"), opt("--mode", choices=MODES, default="hybrid_rerank"),
        opt("--top-k", type=int, default=5), flag("--no-rerank"), flag("--compare"))
    add("evaluate", evaluate_search, opt("library"), opt("tests"), opt("--mode", action="append", choices=MODES),
        opt("--ks", type=int, nargs="+", default=list(EVAL_KS)), flag("--no-rerank"), opt("--query-type", choices=V.QUERY_TYPES), opt("--output"))
    add("export-csv", export_csv, *io)
    add("import-csv", import_csv, opt("input"), opt("csv"), opt("output"), flag("--apply"))
    add("report", report, opt("csv"), opt("--top", type=int, default=10))
    add("audit", audit, opt("library"), opt("canon"))
    add("chunk-report", chunk_report, opt("input"), opt("--text", default="text"), opt("--size", type=int, default=200),
        opt("--overlap", type=int, default=50), opt("--stride", type=int, default=100))
    p.add_argument("--master")
    p.add_argument("--conf", type=json.loads, default={}, help="JSON object of Spark settings")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(get_spark(master=a.master, **a.conf), a)


if __name__ == "__main__":
    main()
