import random

import pytest
from pyspark.sql import functions as F

from shelfspark import session
from shelfspark.operators import canon, enrich, entity, keyed, quality, taxonomy
from shelfspark.plans import ingest


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


RECORD = "path string, folder string, title string, author string, content string, summary string, ai_summary string, genre string, " \
         "categories array<string>, publisher string, publication_year string, word_count long, url string, source string"


def rec(path, folder, title, author, content="", summary="", ai="", genre="", cats=(), publisher="", year="", words=None):
    return (path, folder, title, author, content, summary, ai, genre, list(cats), publisher, year, words, "", "x")


def test_keep_first_and_longest_do_not_depend_on_order(spark):
    rng = random.Random(3)
    rows = [(f"p{i:04}", f"k{rng.choice([0, 0, 0, 1, 2, 3])}", "x" * rng.randint(0, 5)) for i in range(400)]
    want_first, want_long = {}, {}
    for p, k, t in rows:
        want_first.setdefault(k, p)
        if k not in want_long or len(t) > len(want_long[k][1]):
            want_long[k] = (p, t)
    for parts in (1, 8):
        df = frame(spark, rng.sample(rows, len(rows)), "path string, k string, t string").repartition(parts)
        first = keyed.keep_first(df, ["k"], [F.col("path")])
        assert {r["k"]: r["path"] for r in first.collect()} == want_first
        assert {r["k"]: r["path"] for r in keyed.keep_longest(df, ["k"], "t", "path").collect()} == {k: v[0] for k, v in want_long.items()}
        assert {r["path"] for r in keyed.keep_first(first, ["k"], [F.col("path")]).collect()} == set(want_first.values())


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = frame(spark, [("a", "k", "t")], "path string, k string, t string")
    plan = keyed.keep_first(df, ["k"], [F.col("path")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_upsert_last_write_wins(spark):
    base = frame(spark, [(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    new = frame(spark, [(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    assert {r["id"]: r["v"] for r in keyed.upsert(base, new, "id", "n").collect()} == {1: "a", 2: "d", 3: "e"}
    assert [r["id"] for r in keyed.not_done(new, base, "id").collect()] == [3]


def test_entity_merge_rules(spark):
    rows = [
        rec("work/1", "work", "Số Đỏ (tiểu thuyết)", "Vũ Trọng Phụng", content="wiki text", year=""),
        rec("gbooks/1", "gbooks", "số đỏ", "Trọng Phụng Vũ", content="book text", year="1936", cats=["Fiction", "Satire"], publisher="NXB"),
        rec("archive_compact/1", "archive_compact", "Số  đỏ", "", content="card", ai="AI words", words=1200),
        rec("work/2", "work", "Two", "A B", content="one"), rec("work/3", "work", "Two", "C D", content="other"),
        rec("gbooks/2", "gbooks", "Two", "", content="orphan stays"),
        rec("gbooks/3", "gbooks", "Only book", "E F", content="only text", genre="Thơ"),
        rec("work/4", "work", "  ", "X", content="no title"), rec("work/5", "work", "Empty", "Y"),
    ]
    got = {r["key"]: r for r in entity.merge_entities(frame(spark, rows, RECORD).repartition(4)).collect()}
    assert set(got) == {"số đỏ | phụng trọng vũ", "two | a b", "two | c d", "two | ", "only book | e f"}
    s = got["số đỏ | phụng trọng vũ"]
    assert (s["author"], s["year"], s["publisher"], s["summary"], s["source"], s["n_paths"]) == (
        "Vũ Trọng Phụng", "1936", "NXB", "wiki text", "archive_compact, gbooks, wikipedia", 3)
    assert got["only book | e f"]["genres"] == ["Thơ"]
    assert "only book | e f" not in {r["key"] for r in entity.merge_entities(frame(spark, rows, RECORD), use_gbooks_text=False).collect()}
    chunk = [r for r in entity.inject_metadata(entity.merge_entities(frame(spark, rows, RECORD))).collect() if r["year"] == "1936"][0]
    assert chunk["text"] == ("[Tiêu đề: số đỏ] | [Tác giả: Vũ Trọng Phụng] | [Năm xuất bản: 1936] | [Thể loại: Fiction, Satire] | [Nhà xuất bản: NXB]"
                             " | [Độ dài tác phẩm: ~1200 từ]\n\nTóm tắt AI: AI words\n\nNội dung chi tiết:\nwiki text") or chunk["title"] != "số đỏ"
    assert chunk["genre"] == "Fiction" and chunk["end_word"] == len(chunk["text"].split())


def test_long_entity_text_is_cut(spark):
    rows = [rec("work/1", "work", "T", "A", content="z" * 5000)]
    text = entity.inject_metadata(entity.merge_entities(frame(spark, rows, RECORD))).first()["text"]
    assert len(text) == 3003 and text.endswith("z...")


def test_catalogue_fields_and_paths(spark):
    rows = [
        rec("a", "work", "Book", "Au", summary="short", genre="", year="", cats=["Nhà văn Việt Nam"]),
        rec("b", "gbooks", "BOOK", "AU", summary="a longer summary", genre="Thơ", year="1950"),
        rec("c", "archive_compact", "book", "au", ai="same length text", genre="Kịch"),
    ]
    df = frame(spark, rows, RECORD)
    r = entity.catalogue(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["title"], r["entity_type"], r["genre"], r["publication_year"], r["summary"], r["source"], r["first_record"], r["n_paths"]) == (
        "Book", "author", "Thơ", "1950", "a longer summary", "archive_compact, gbooks, wikipedia", "a", 3)
    assert sorted(x["path"] for x in entity.entity_paths(df).collect()) == ["a", "b", "c"]


def test_enrich_and_write_back(spark):
    rows = frame(spark, [("1", "T", "work", "", "", "Thơ", "", "0x", "p1; p2;"), ("2", "P", "author", "", "", "", "", "", "p3")],
                 "id string, title string, entity_type string, author string, publication_year string, genre string, publisher string, page_count string, source_paths string")
    s = F.create_map(F.lit("author"), F.lit(" Nam Cao "), F.lit("publication_year"), F.lit("about 1941"), F.lit("publisher"), F.lit("N/A"))
    out = {r["id"]: r for r in enrich.enrich(rows, s).collect()}
    assert (out["1"]["author"], out["1"]["publication_year"], out["1"]["publisher"], out["1"]["ai_filled"]) == ("Nam Cao", "1941", "", "author,publication_year")
    assert out["2"]["ai_filled"] == ""
    docs = frame(spark, [("p1", "", "0", "x", None, "0"), ("p2", "Own", None, "", "", "12"), ("p9", "", "", "", "", "")],
                 "path string, author string, publication_year string, genre string, publisher string, page_count string")
    done = {r["path"]: r for r in enrich.write_back(docs, enrich.explode_paths(enrich.enrich(rows, s))).collect()}
    assert done["p1"]["changed"] == ["author", "publication_year", "page_count"] and done["p1"]["genre"] == "x"
    assert done["p2"]["changed"] == ["publication_year", "genre"] and done["p2"]["author"] == "Own"
    assert done["p9"]["changed"] == []


def test_a_work_of_many_records_is_written_back_whole(spark):
    docs = entity.with_record_fields(frame(spark, [rec(f"p{i}", "work", "Hot", "A", genre="") for i in range(1200)], RECORD))
    rows = enrich.enrich(entity.catalogue(docs), F.create_map(F.lit("genre"), F.lit("Thơ")))
    done = enrich.write_back(docs, rows.join(entity.entity_paths(docs).select("id", "record_id"), "id"))
    assert {r["genre"] for r in done.collect()} == {"Thơ"} and done.count() == 1200


def test_records_of_one_file_are_told_apart(spark):
    docs = frame(spark, [("f", "f", "A", ""), ("f", "f#1#0", "B", "")], "path string, record_id string, title string, genre string")
    docs = docs.withColumns({f: F.lit("x") for f in ("author", "publication_year", "publisher", "page_count")})
    rows = frame(spark, [("1", "f", "Thơ"), ("2", "f#1#0", "Kịch")], "id string, record_id string, genre string").withColumns(
        {f: F.lit("") for f in ("author", "publication_year", "publisher", "page_count")})
    assert {r["title"]: r["genre"] for r in enrich.write_back(docs, rows).collect()} == {"A": "Thơ", "B": "Kịch"}


def test_an_older_version_that_comes_late_loses(spark):
    base = frame(spark, [(1, "new", 9), (2, "old", 1)], "id int, v string, n int")
    late = frame(spark, [(1, "late", 3), (2, "next", 2), (2, "same", 2)], "id int, v string, n int")
    got = {r["id"]: r["v"] for r in keyed.upsert(base, late, "id", "n").collect()}
    assert got[1] == "new" and got[2] in ("next", "same")
    assert got == {r["id"]: r["v"] for r in keyed.upsert(base, late.repartition(2), "id", "n").collect()}


def test_fill_rates(spark):
    df = frame(spark, [("A", "x" * 50, "author"), (" ", "short", ""), ("B", None, "summary,author")], "author string, summary string, ai_filled string")
    r = {x["field"]: x for x in quality.fill_rate(df, ("author", "summary")).collect()}
    assert (r["author"]["filled"], r["summary"]["filled"], r["author"]["pct"]) == (2, 1, 66.7)
    b = {x["field"]: x for x in quality.before_after(df, ("author", "summary")).collect()}
    assert (b["author"]["before"], b["author"]["after"], b["author"]["added"]) == (0, 2, 2)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_title_matching_equals_nested_loop(spark, monkeypatch, bound):
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", bound)
    rng = random.Random(7)
    word = lambda: rng.choice(["so", "do", "chi", "pheo", "đất", "Tắt", "đèn", "x"])
    titles = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(120)]
    expected = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(40)]

    import re
    import unicodedata
    def norm(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s)).strip()

    nt = [norm(t) for t in titles]
    want = {}
    for i, c in enumerate(map(norm, expected)):
        hit = nt.index(c) if c in nt else None
        if hit is None and len(c) >= 4:
            hit = next((j for j, t in enumerate(nt) if t and (f" {c} " in f" {t} " or f" {t} " in f" {c} ")), None)
        want[i] = hit
    got = canon.match_titles(frame(spark, list(enumerate(expected)), "canon_id int, title string"),
                             frame(spark, list(enumerate(titles)), "position int, title string"))
    assert {r["canon_id"]: r["position"] for r in got.collect()} == want


def test_category_walk_visits_once(spark):
    edges = frame(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "r")], "parent string, child string")
    scans = [taxonomy.walk(edges, frame(spark, [("r",)], "root string"), n)._jdf.queryExecution().optimizedPlan().toString().count("level-") for n in (2, 4)]
    assert scans[1] <= 2 * scans[0] + 2  # each level is read, not computed again
    seen = taxonomy.walk(edges, frame(spark, [("r",)], "root string"), 3)
    assert {r["category"]: r["depth"] for r in seen.collect()} == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    pages = taxonomy.pages_under(seen, frame(spark, [("c", 1), ("a", 1), ("d", 2), ("e", 3)], "category string, page_id int"))
    assert {r["page_id"]: r["depth"] for r in pages.collect()} == {1: 1, 2: 3}


BOOK = "path string, id string, title string, url string, author string, authors array<string>, publication_year string, genre string, " \
       "genres array<string>, publisher string, page_count int, isbn string, isbn_list array<string>, cover_url string, summary string, " \
       "content string, categories array<string>, crawl_category string, language string"


def book(path, title="T", author="A", content="c" * 30, summary="", lang="vi", genre="", cats=()):
    return (path, path, title, "", author, [author], "", genre, [], "", 0, "", [], "", summary, content, list(cats), "", lang)


def test_book_cleaning_and_funnel(spark):
    rows = [book("1"), book("2", content="c" * 40), book("3", content="c" * 40), book("4", lang="en"), book("5", title="S", content="", summary="s" * 19),
            book("6", title="S2", content="", summary="s" * 20), book("7", title="Luật", genre="Luật"), book("8", title="Luật thơ", genre="Luật"),
            book("9", title=" t ", author="a", content="x\x00  y" + "z" * 60)]
    df = frame(spark, rows, BOOK)
    out = {r["id"]: r for r in ingest.clean_books(df).collect()}
    assert set(out) == {"9", "6", "8"}
    assert out["9"]["content"] == "x y" + "z" * 60 and out["9"]["summary"].startswith("x y")
    f = ingest.funnel(df).first()
    assert [f[c] for c in ("total_raw", "after_lang", "after_short", "after_topic", "after_dedup")] == [9, 8, 7, 6, 3]
    assert {r["id"] for r in ingest.clean_books(df, filter_topic=False).collect()} == {"9", "6", "7", "8"}


def test_article_and_archive_cleaning(spark):
    body = "B" * 60
    rows = [("x/1", "7", "T", "", "Nhà văn Việt Nam", ["1820", "Thơ"], f"{body}\n== Tham khảo ==\nref", None, None, None),
            ("x/2", "7", "T2", "", "", [], body, None, None, None), ("x/3", "8", "T3", "", "", [], "short", None, None, None), ("x/4", "", "T4", "", "", [], body, None, None, None)]
    out = ingest.clean_articles(frame(spark, rows, "path string, id string, title string, url string, category string, categories array<string>, content string, language string, crawled_at string, last_modified string")).collect()
    assert [(r["id"], r["title"], r["type"], r["categories"], r["content"], r["language"]) for r in out] == [("7", "T", "author", ["Thơ"], body, "vi")]
    texts = frame(spark, [("p", "Chí Phèo", "Nam Cao", "w " * 400), ("q", "S", "N", "tiny")], "path string, title string, author string, content string")
    cards = ingest.book_cards(ingest.clean_archive(texts.withColumn("content", F.trim("content")))).collect()
    assert len(cards) == 1 and cards[0]["content"].startswith("Tác phẩm: Chí Phèo\nTác giả: Nam Cao\nĐộ dài: 400 từ (~1 trang (truyện ngắn/thơ))\n")
