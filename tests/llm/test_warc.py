import hashlib
import random

from shelfspark.llm.warc import archive, audit, build, fingerprints, gzip_records, height, parse_warc, read_warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, status string, leaf string").repartition(3)


def replica(spark, rows):
    return archive(pages(spark, rows))


ROWS = [(i, f"http://h/{i}", f"<p>{'é' * (i % 7)}{i}</p>") for i in range(300)]


def test_equal_replicas(spark):
    assert audit(replica(spark, ROWS), replica(spark, list(reversed(ROWS)))).count() == 0
    empty = replica(spark, ROWS).limit(0)
    assert audit(empty, empty).count() == 0
    assert {r.status for r in audit(replica(spark, ROWS), empty).collect()} == {"missing"}
    assert audit(empty, replica(spark, ROWS)).count() == 300


def test_finds_all_damage_and_its_place(spark):
    bad = [(i, u, "#" + h[1:]) if i in (0, 17, 255) else (i, u, h) for i, u, h in ROWS if i != 100] + [(10**12, "new", "new")]
    got = {r.key: r for r in audit(replica(spark, ROWS), replica(spark, bad)).collect()}
    assert {k: r.status for k, r in got.items()} == {0: "changed", 17: "changed", 255: "changed", 100: "missing", 10**12: "extra"}
    records = [bytes(r.record) for r in replica(spark, ROWS).orderBy("key").collect()]
    for k in (0, 17, 100, 255):
        first = k // 16 * 16
        assert got[k].range_offset == sum(map(len, records[:first])) and got[k].range_bytes == sum(map(len, records[first:first + 16]))
        assert got[k].expected_sha256 == hashlib.sha256(records[k]).hexdigest()


def test_nulls_repeats_and_odd_keys(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, None, None), (-5, "n", "z"), (10**15, "q", "w"), (40, "k", "k")]
    other = [(1, "a", "x"), (1, "b", "y"), (None, None, None), (-5, "n", "Z"), (10**15, "q", "w"), (77, "k", "k")]
    got = {(r.key, r.status, r.n_expected, r.n_found) for r in audit(replica(spark, rows), replica(spark, other)).collect()}
    assert got == {(1, "missing", 1, 0), (-5, "changed", 1, 1), (40, "missing", 1, 0), (77, "extra", 0, 1)}
    assert audit(replica(spark, rows), replica(spark, rows)).count() == 0


def test_one_key_for_all(spark):
    rows = [(7, f"u{i}", "x") for i in range(500)]
    (row,) = audit(replica(spark, rows), replica(spark, rows[1:])).collect()
    assert (row.key, row.status, row.n_expected) == (7, "missing", 1)


def test_tree_depends_on_order_of_bytes_only(spark):
    prints = fingerprints(replica(spark, ROWS))
    assert height(prints) == 2 and build(prints, 2).root() == build(fingerprints(replica(spark, ROWS[::-1])), 2).root()
    moved = [(i, u, ROWS[1 - i][2]) if i < 2 else (i, u, h) for i, u, h in ROWS]
    assert build(fingerprints(replica(spark, moved)), 2).root() != build(prints, 2).root()


def test_files_plain_and_gzipped(spark, tmp_path):
    records = [bytes(r.record) for r in replica(spark, ROWS[:9]).orderBy("key").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(gzip_records(records))
    rows = read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [bytes(r.body).decode() for r in rows] == [h for _, _, h in ROWS[:9]] * 2
    assert [r.uri for r in rows[:9]] == [u for _, u, _ in ROWS[:9]] and {r.type for r in rows} == {"resource"}
    assert sum(r.length for r in rows[:9]) == len(b"".join(records))
    assert list(parse_warc(b"")) == [] and list(parse_warc(b"junk")) == []


def test_parser_is_linear_in_the_number_of_records():
    import time
    record = lambda i: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: 4000\r\n\r\n".encode() + random.Random(i).randbytes(4000) + b"\r\n\r\n"
    took = []
    for n in (1500, 12000):
        data = gzip_records([record(i) for i in range(n)])
        begin = time.perf_counter()
        found = list(parse_warc(data))
        took.append(time.perf_counter() - begin)
        assert len(found) == n and sum(size for _, size, _, _ in found) == len(data) and found[-1][2]["WARC-Record-ID"] == f"<r{n - 1}>" and len(found[-1][3]) == 4000
    assert took[1] < 40 * took[0]  # 8 times as many; the square would be 64
    cut = data[:len(data) - 100]
    assert len(list(parse_warc(cut))) == n and len(list(parse_warc(cut))[-1][3]) < 4000
