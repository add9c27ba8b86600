import json

from shelfspark import cli
from shelfspark.plans import library_build
from shelfspark.sources import readers


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")


def test_from_raw_records_to_search_and_report(spark, tmp_path, capsys):
    t = str(tmp_path)
    put(tmp_path / "raw" / "page_1.json", {"id": "1", "title": "Chí Phèo", "category": "Truyện ngắn Việt Nam", "url": "https://vi.wikipedia.org/wiki/a",
                                           "content": "Chí Phèo là truyện ngắn của Nam Cao kể về làng Vũ Đại ngày ấy."})
    put(tmp_path / "books" / "gbooks_1.json", {"id": "gbooks_1", "title": "Tập thơ", "author": "Xuân Diệu", "language": "vi", "content": "thơ tình " * 10})
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "Lão Hạc - Nam Cao.txt").write_text("Lão Hạc có con chó vàng. " * 20, encoding="utf-8")
    for i in range(4):  # several records end up in one part file
        (tmp_path / "txt" / f"Truyện {i} - Nam Cao.txt").write_text(f"Truyện số {i} kể về làng quê. " * 20, encoding="utf-8")
    cli.main(["clean-articles", f"{t}/raw", f"{t}/in"])
    cli.main(["clean-books", f"{t}/books", f"{t}/in/gbooks"])
    cli.main(["clean-books", f"{t}/books", f"{t}/none", "--dry-run"])
    cli.main(["clean-archive", f"{t}/txt", f"{t}/in/archive_compact", "--cards"])
    cleaned = readers.read_source_folders(spark, f"{t}/in", library_build.FOLDERS)
    assert sorted(r["folder"] for r in cleaned.collect()) == ["archive_compact"] * 5 + ["gbooks", "work"] and cleaned.count() == 7
    cli.main(["build", f"{t}/in", f"{t}/lib"])
    capsys.readouterr()
    cli.main(["search", f"{t}/lib", "chó vàng lão hạc", "--compare", "--top-k", "1"])
    out = capsys.readouterr().out
    assert out.count("Lão Hạc") >= 4 and "hybrid_rerank" in out
    put(tmp_path / "tests.json", {"query_id": "F1", "query": "truyện ngắn nam cao", "query_type": "FACTUAL", "relevant_keywords": ["chí phèo"]})
    cli.main(["evaluate", f"{t}/lib", f"{t}/tests.json", "--ks", "1", "3", "--mode", "bm25", "--output", f"{t}/report"])
    assert "FACTUAL" in capsys.readouterr().out
    cli.main(["export-csv", f"{t}/in", f"{t}/csv"])
    cli.main(["report", f"{t}/csv"])
    cli.main(["import-csv", f"{t}/in", f"{t}/csv", f"{t}/next", "--apply"])
    again = readers.read_source_folders(spark, f"{t}/next", library_build.FOLDERS)
    key = lambda df: sorted((r["folder"], r["record_id"], r["title"]) for r in df.collect())
    assert key(again) == key(cleaned)
    cli.main(["build", f"{t}/next", f"{t}/lib2"])
    assert spark.read.parquet(f"{t}/lib2/entities").count() == spark.read.parquet(f"{t}/lib/entities").count() == 7
    put(tmp_path / "canon.json", {"canon_id": 1, "title": "Lão Hạc", "author": "Nam Cao"})
    capsys.readouterr()
    cli.main(["audit", f"{t}/lib", f"{t}/canon.json"])
    assert "100.0" in capsys.readouterr().out
