import random

from pyspark.sql import functions as F

from shelfspark.operators import memory, scan


def test_running_sums_of_hot_null_and_single_keys(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.randrange(10 ** 12)]) if k == "b" else 1_700_000_000_000 + 977 * i, rng.randrange(9))
            for k, n in (("a", 900), ("b", 40), (None, 70), ("c", 1)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, p long, v long, id long")
    out = scan.running(df, ["k"], [F.col("p"), F.col("id")], {"n": F.lit(1), "s": F.col("v")}, totals=True, maxima={"top": F.col("p")}, block=50)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    low = lambda p: (-1 if p is None else p)
    for i, (k, p, _) in enumerate(rows):
        mine = [(low(pp), j, vv) for j, (kk, pp, vv) in enumerate(rows) if kk == k]
        upto = [m for m in mine if m[:2] <= (low(p), i)]
        assert (got[i]["n"], got[i]["s"]) == (len(upto), sum(m[2] for m in upto))
        assert (got[i]["n_total"], got[i]["s_total"], low(got[i]["top"])) == (len(mine), sum(m[2] for m in mine), max(m[0] for m in mine))


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, p long, v long")
    assert scan.running(df, ["k"], [F.col("p")], {"s": F.col("v")}, totals=True).count() == 0


def test_ranges_of_time_like_positions_are_bounded(spark, monkeypatch):
    seen = []
    write = scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda df, name: seen.append(write(df, name)) or seen[-1])
    df = spark.range(4000).select((F.col("id") % 3 * F.col("id") % 2).alias("k"), (F.col("id") * F.col("id") * 1000 + 1_700_000_000_000).alias("p"), F.lit(1).alias("v"))
    out = memory.suffix_sums(df, "k", "p", ["v"], block=200)
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 600
    assert {r["v_total"] for r in out.collect()} == {r["count"] for r in df.groupBy("k").count().collect()}
