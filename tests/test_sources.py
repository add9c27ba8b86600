import json

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.plans import library_build
from shelfspark.operators.bm25 import Queries
from shelfspark.operators.quality import before_after
from shelfspark.plans.registry import chat
from shelfspark.sources import readers, remote, sinks
from shelfspark.streaming import incremental


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")


def test_json_folder_skips_broken_files(spark, tmp_path):
    put(tmp_path / "b" / "page_2.json", {"id": "1", "title": "second", "extra": 5})
    put(tmp_path / "a" / "page_1.json", {"id": "1", "title": "first"})
    put(tmp_path / "a" / "page_9.json", "{not json")
    put(tmp_path / "a" / "other.json", {"id": "2"})
    df = readers.read_json_folder(spark, str(tmp_path), readers.ARTICLE_SCHEMA, "page_*.json")
    got = sorted((r["folder"], r["title"]) for r in df.collect())
    assert got == [("a", "first"), ("b", "second")]
    assert df.count() == 2
    assert readers.count_broken(spark, str(tmp_path), readers.ARTICLE_SCHEMA, "page_*.json") == 1
    assert [r["title"] for r in readers.read_json_folder(spark, str(tmp_path), readers.ARTICLE_SCHEMA, "page_*.json", limit=1).collect()] == ["first"]


def test_a_file_of_many_records_is_read_whole(spark, tmp_path):
    put(tmp_path / "work" / "lines.json", "\n".join(json.dumps({"id": str(i), "title": "}\n{"}) for i in range(5)))
    put(tmp_path / "work" / "list.json", [{"id": "a"}, {"id": "b"}])
    put(tmp_path / "work" / "pretty.json", json.dumps({"id": "c", "authors": ["x"]}, indent=2) + "\n" + json.dumps({"id": "d"}, indent=2))
    put(tmp_path / "work" / "meta.json", {"id": "skip"})
    df = readers.read_source_folders(spark, str(tmp_path), ["work", "none"])
    assert sorted(r["id"] for r in df.collect()) == ["0", "1", "2", "3", "4", "a", "b", "c", "d"] and df.count() == 9
    assert len({r["record_id"] for r in df.collect()}) == 9


def test_text_files_carry_title_and_author_in_their_name(spark, tmp_path):
    put(tmp_path / "A - B - Nam Cao.txt", "  words  ")
    put(tmp_path / "Không tên.txt", "x")
    (tmp_path / "Bad - Z.txt").write_bytes(b"ok \xff\xfe end")
    got = sorted((r["title"], r["author"], r["content"]) for r in readers.read_texts(spark, str(tmp_path)).collect())
    assert got == [("A - B", "Nam Cao", "words"), ("Bad", "Z", "ok  end"), ("Không tên", "Khuyết Danh", "x")]


def test_metadata_csv_with_mark_quotes_and_newlines(spark, tmp_path):
    head = ",".join(["id", "title", "entity_type", "author", "publication_year", "genre", "publisher", "page_count", "isbn", "cover_url", "summary", "source", "source_paths", "ai_filled"])
    (tmp_path / "m.csv").write_text("﻿" + head + '\n1,"A ""q""",work,N,1941,,,,,,"two\nlines",wiki,p1;p2,"author,genre"\n', encoding="utf-8")
    r = readers.read_metadata_csv(spark, str(tmp_path / "m.csv")).first()
    assert (r["id"], r["title"], r["summary"], r["source_paths"], r["ai_filled"]) == ("1", 'A "q"', "two\nlines", "p1;p2", "author,genre")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'x "y", z', "l1\nl2")], "id string, title string, summary string")
    sinks.write_csv(df, str(tmp_path / "out"), ("id", "title", "summary"))
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfid,") for f in (tmp_path / "out").glob("*.csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("1", 'x "y", z', "l1\nl2")]


def test_vectors_need_one_payload_each(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "v"))
    spark.range(2).write.parquet(str(tmp_path / "p"))
    try:
        readers.read_vectors(spark, str(tmp_path / "v"), str(tmp_path / "p"))
        raise AssertionError("must refuse")
    except ValueError as e:
        assert "1 without payload, 0 without vector" in str(e)
    spark.range(3, 6).write.parquet(str(tmp_path / "q"))
    try:
        readers.read_vectors(spark, str(tmp_path / "v"), str(tmp_path / "q"))
        raise AssertionError("must refuse")
    except ValueError as e:
        assert "3 without payload, 3 without vector" in str(e)
    spark.range(3).write.parquet(str(tmp_path / "w"))
    assert readers.read_vectors(spark, str(tmp_path / "v"), str(tmp_path / "w")).count() == 3


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_recorded_volumes(spark, tmp_path):
    vol = lambda i, **v: {"id": i, "volumeInfo": v}
    long = "mô tả " * 10
    put(tmp_path / "thơ" / "0.json", {"totalItems": 3, "items": [
        vol("v1", title=" Tập thơ ", authors=["A", "B"], description=long, publishedDate="2005-03", categories=["Juvenile Fiction"], language="vi", pageCount=12,
            industryIdentifiers=[{"type": "ISBN_10", "identifier": "1234567890"}, {"type": "ISBN_13", "identifier": "9781234567890"}, {"type": "OTHER", "identifier": "9"}],
            imageLinks={"smallThumbnail": "s.png"}), vol("v2", title="No text"), vol("", title="No id", description=long)]})
    put(tmp_path / "thơ" / "1.json", {"totalItems": 3, "items": [vol("v3", title="T", description=long)]})
    pages = remote.read_catalogue(spark, ["thơ", "nothing"], folder=str(tmp_path))
    got = {r["id"]: r for r in remote.parse_volumes(pages).collect()}
    assert set(got) == {"gbooks_v1", "gbooks_v3"}
    v = got["gbooks_v1"]
    assert (v["title"], v["author"], v["publication_year"], v["genre"], v["isbn"], v["cover_url"], v["page_count"]) == (
        "Tập thơ", "A", "2005", "Tiểu thuyết", "9781234567890", "s.png", 12)
    assert got["gbooks_v3"]["url"] == "https://books.google.com/books?id=v3" and got["gbooks_v3"]["year_source"] == ""


def test_a_catalogue_is_followed_to_its_last_page(spark, tmp_path):
    for page in range(30):
        put(tmp_path / "Thơ" / f"{page}.json", {"query": {"categorymembers": [{"pageid": page, "ns": 0, "title": "X"}]}})
    put(tmp_path / "Gap" / "1.json", {})
    assert remote.read_catalogue(spark, ["Thơ", "Gap"], folder=str(tmp_path)).count() == 30
    assert remote.read_catalogue(spark, ["Thơ"], folder=str(tmp_path), max_pages="7").count() == 7
    assert remote.read_volume_search(spark, ["Thơ"], folder=str(tmp_path)).count() == 25


def test_recorded_categories_and_claims(spark, tmp_path):
    put(tmp_path / "Thơ" / "0.json", {"query": {"categorymembers": [{"pageid": 5, "ns": 0, "title": "X"}, {"pageid": 6, "ns": 14, "title": "Thể loại:Con"}]}})
    m = remote.parse_members(remote.read_catalogue(spark, ["Thơ"], folder=str(tmp_path))).collect()
    assert sorted((r["page_id"], r["title"], r["is_category"]) for r in m) == [(5, "X", False), (6, "Con", True)]
    val = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    body = json.dumps({"claims": {"P577": [val({"time": "+1965-01-01T00:00:00Z"})], "P50": [val({"id": f"Q{i}"}) for i in range(1, 8)], "P136": [val({"id": "Q9"}), {"mainsnak": {}}]}})
    labels = spark.createDataFrame([(f"Q{i}", f"L{i}") for i in range(2, 10)], "qid string, label string")
    entities = spark.createDataFrame([("QA", body), ("QB", "{}")], "qid string, body string")
    claims = remote.parse_claims(entities, labels)
    r = {x["qid"]: x for x in claims.collect()}
    assert (r["QA"]["publication_year"], r["QA"]["authors"], r["QA"]["genre"], r["QA"]["birth_year"]) == ("1965", ["L2", "L3", "L4", "L5"], "L9", "")
    assert r["QB"]["author"] == ""
    articles = spark.createDataFrame([("1", "QA", "{{Infobox\n| tác giả = Box\n}}", "là truyện ngắn", ["c"]), ("2", "QB", "", "xuất bản năm 1941", ["Thơ"])],
                                     "id string, wikidata_id string, wikitext string, content string, categories array<string>")
    b = {x["id"]: x for x in remote.build_books(articles, claims).collect()}
    assert (b["1"]["author"], b["1"]["author_source"], b["1"]["authors"], b["1"]["year_source"], b["1"]["genre"], b["1"]["genre_source"]) == ("Box", "infobox", ["Box"], "wikidata", "L9", "wikidata")
    assert (b["2"]["publication_year"], b["2"]["year_source"], b["2"]["genre"], b["2"]["genre_source"], b["2"]["author_source"]) == ("1941", "regex", "Thơ", "categories", "")
    people = remote.build_authors(spark.createDataFrame([("1", "QA", "{{x\n| sinh = 3 tháng 2 năm 1915\n| tác phẩm = A, B ,\n}}")], "id string, wikidata_id string, wikitext string"), claims).first()
    assert (people["birth_year"], people["birth_source"], people["notable_works"]) == ("1915", "infobox", ["A", "B"])


def test_build_and_open_library(spark, tmp_path):
    put(tmp_path / "in" / "work" / "page_1.json", {"id": "1", "title": "Chí Phèo", "author": "Nam Cao", "content": "Chí Phèo là truyện ngắn về làng Vũ Đại", "url": "https://vi.wikipedia.org/x"})
    put(tmp_path / "in" / "gbooks" / "gbooks_1.json", {"id": "g", "title": "Chí phèo", "author": "Cao Nam", "publisher": "NXB Trẻ", "content": "bản in"})
    put(tmp_path / "in" / "gbooks" / "gbooks_meta.json", {"id": "m", "title": "meta"})
    put(tmp_path / "in" / "archive_compact" / "c.json", {"id": "c", "title": "Khác", "author": "X", "content": "thơ về biển"})
    put(tmp_path / "in" / "author" / "a.json", {"id": "a", "title": "Nam Cao", "content": "nhà văn"})
    library_build.build(spark, str(tmp_path / "in"), str(tmp_path / "lib"))
    lib = library_build.open_library(spark, str(tmp_path / "lib"))
    assert lib.docs.count() == 3
    q = Queries.of(spark.createDataFrame([(1, "chi pheo nxb")], "query_id long, query string"))
    best = lib.search(q, 1).join(lib.docs, "doc_id").first()
    assert (best["title"], best["publisher"], best["source"]) in {("Chí Phèo", "NXB Trẻ", "gbooks, wikipedia"), ("Chí phèo", "NXB Trẻ", "gbooks, wikipedia")}


def test_latex_rows(spark):
    df = spark.createDataFrame([("Tác", "1941", "", "", "", "s", "author")], "author string, publication_year string, genre string, publisher string, page_count string, summary string, ai_filled string")
    got = {r["field"]: r["latex"] for r in sinks.latex_fill_rows(before_after(df)).collect()}
    assert got["author"] == r"author & $0{,}0\%$ & $100{,}0\%$ & 1 \\"


# ------------------------------------------------------------------ streaming
def test_ingest_twice_adds_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "id int, v string").write.parquet(str(tmp_path / "in"))
    for cp in ("cp1", "cp2"):   # the second run starts from an empty checkpoint, as after a loss
        s = incremental.read_stream(spark, str(tmp_path / "in"), "id int, v string")
        incremental.ingest_new(s, str(tmp_path / "out"), str(tmp_path / cp), "id", "v").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]


def test_stream_upserts_over_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "z", 2), (3, "c", 1)]]):
        spark.createDataFrame(rows, "id int, v string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = incremental.read_stream(spark, str(tmp_path / "in"), "id int, v string, n int")
        incremental.ingest_upsert(s, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "n").awaitTermination()
    assert {r["id"]: r["v"] for r in incremental.read_upserted(spark, str(tmp_path / "out")).collect()} == {1: "z", 2: "b", 3: "c"}


def test_progress_table(spark, tmp_path):
    spark.createDataFrame([("q1",), ("q1",), ("q2",)], "query string").write.parquet(str(tmp_path / "in"))
    incremental.track_progress(incremental.read_stream(spark, str(tmp_path / "in"), "query string"), str(tmp_path / "out"), str(tmp_path / "cp"), "query").awaitTermination()
    total = spark.read.parquet(str(tmp_path / "out")).groupBy("query").agg(F.sum("count").alias("n"))
    assert {r["query"]: r["n"] for r in total.collect()} == {"q1": 2, "q2": 1}


def test_conversation_state_over_batches(spark, tmp_path):
    ddl = "conv_id long, turn long, role string, text string"
    for batch in ([(1, 0, "user", "aa"), (1, 1, "assistant", "b")], [(1, 2, "user", "cccc"), (2, 0, "user", "x")]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = incremental.read_stream(spark, str(tmp_path / "in"), ddl)
        incremental.track_conversations(s, str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    got = incremental.read_conversations(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1, 5), (2, 1, 0, 1)]


def test_conversation_state_survives_a_restart_and_expires(spark, tmp_path):
    ddl = "conv_id long, turn long, role string, text string"

    def feed(rows, **options):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = incremental.read_stream(spark, str(tmp_path / "in"), ddl)
        incremental.track_conversations(s, str(tmp_path / "out"), str(tmp_path / "cp"), 3, **options).awaitTermination()
        return sorted(tuple(r) for r in incremental.read_conversations(spark, str(tmp_path / "out")).collect())
    feed([(1, t, "user", "x" * t) for t in range(6)], expire_ms=600_000)
    # Every feed is a new query on the same checkpoint; an older turn arrives late.
    assert feed([(1, 2, "user", "late"), (1, 9, "user", "abc"), (2, 0, "user", "y")], expire_ms=600_000) == [(1, 8, 5, 3 + 5 + 4), (2, 1, 0, 1)]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("v=")]


def test_expired_conversations_are_forgotten(spark, tmp_path):
    ddl = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(1, 0, "user", "x")], ddl).write.parquet(str(tmp_path / "in"))
    incremental.track_conversations(incremental.read_stream(spark, str(tmp_path / "in"), ddl), str(tmp_path / "out"), str(tmp_path / "cp"), 3, expire_ms=1).awaitTermination()
    assert incremental.read_conversations(spark, str(tmp_path / "out")).count() == 0


def test_conversations_share_the_groups_of_the_state(spark, tmp_path, monkeypatch):
    """One group per block and not per conversation; rows come in slices, ids beyond 2^53 stay exact beside nulls."""
    monkeypatch.setattr(incremental, "BLOCKS", 3)
    ddl = "conv_id long, turn long, role string, text string"
    ids = [None, *range(2**53 + 1, 2**53 + 21)]
    batches = [[(c, t, "user", "x" * (t + i)) for i, c in enumerate(ids) for t in range(5)],
               [(ids[1], None, "user", "oldest"), (ids[2], 9, "user", None), (ids[3], 9, "user", "abc"), (7, 0, "user", "y")]]
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = incremental.read_stream(spark, str(tmp_path / "in"), ddl)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        try:
            incremental.track_conversations(s, str(tmp_path / "out"), str(tmp_path / "cp"), 3).awaitTermination()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {c: (5, 2, 2 + 3 + 4 + 3 * i) for i, c in enumerate(ids)}
    expected |= {ids[1]: (6, 3, 2 + 3 + 4 + 3), ids[2]: (6, 3, 3 + 4 + 2 * 2), ids[3]: (6, 3, 3 + 4 + 2 * 3 + 3), 7: (1, 0, 1)}
    assert {r[0]: tuple(r)[1:] for r in incremental.read_conversations(spark, str(tmp_path / "out")).collect()} == expected
    state = spark.read.format("statestore").option("stateVarName", "conversation").load(str(tmp_path / "cp"))
    assert state.select("key").distinct().count() <= 3


def test_a_conversation_costs_two_calls_of_the_state_per_slice():
    calls, stored = [], {}

    class State:
        def getValue(self, key):
            calls.append("get")
            return stored.get(key)

        def updateValue(self, key, value):
            calls.append("update")
            stored[key] = value

    window = incremental._Window("conv_id", "turn", 2, None)
    window.state = State()
    rows = pd.DataFrame({"conv_id": ["a", "b"] * 50, "turn": range(100), "size": 1})
    assert list(window.handleInputRows((0,), iter([rows, rows]), None)) == []
    assert stored == {("a",): (100, [98, 98], [1, 1]), ("b",): (100, [99, 99], [1, 1])}
    assert calls == ["get", "update"] * 4


def test_conversation_states_keep_messages_of_odd_turns(spark, tmp_path):
    rows = [(1, t, "user", "x" * n) for n, t in enumerate([-3, -1, 0, 2, 7, None])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in chat.conversation_states(spark, str(tmp_path)).collect()] == [(1, 6, 2, 1 + 2 + 3 + 4)]


def test_seen_keys_are_state(spark, tmp_path):
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(2, "x"), (3, "c")], [(1, "y"), (3, "z")]):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = incremental.read_stream(spark, str(tmp_path / "in"), "id int, v string")
        incremental.ingest_new(s, str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_append_reads_the_touched_key_folders_and_recovers(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_new(spark.range(500).select(F.col("id"), F.lit("a").alias("v")), path, buckets=16)
    added = sinks.append_new(spark.range(3, 5).unionByName(spark.range(900, 901)).select("id", F.lit("b").alias("v")), path, buckets=16)
    assert [r.id for r in added.collect()] == [900] and spark.read.parquet(path).columns == ["id", "v"]
    # A batch that wrote its rows but not its keys: the keys are taken from the rows again.
    spark.range(1000, 1003).select("id", F.lit("c").alias("v")).write.mode("append").parquet(path)
    (tmp_path / "t" / "_pending").write_text("")
    assert sinks.append_new(spark.range(998, 1004).select("id", F.lit("d").alias("v")), path, buckets=16).count() == 3
    assert spark.read.parquet(path).groupBy("id").count().filter("count > 1").count() == 0


def test_claims_decode_a_body_once(spark):
    """No path is looked up in the whole body, and names come from one aggregate; odd bodies give empty fields."""
    val = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    good = json.dumps({"claims": {"P50": [{"mainsnak": {}}, val("text"), val({"id": "Q2"}), val({"id": "Q1"})], "P27": [val({"id": "Q1"})]}})
    entities = spark.createDataFrame([("A", good), ("B", '{"claims": []}'), ("C", good[:-9]), ("D", None)], "qid string, body string")
    c = remote.parse_claims(entities, spark.createDataFrame([("Q1", "one"), ("Q2", "two")], "qid string, label string"))
    got = {r["qid"]: (r["authors"], r["genre"], r["nationality"]) for r in c.collect()}
    assert got == {"A": (["two", "one"], "", "one"), "B": (None, "", ""), "C": (None, "", ""), "D": (None, "", "")}
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object(body" not in plan and plan.count("Aggregate [") == 1
