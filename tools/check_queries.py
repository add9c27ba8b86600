"""Run registered queries next to their SQL form and compare rows, columns and values.

usage: python tools/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int,)):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    t = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return "rows-only", len(got[1]), took, ""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), took, f"{got[0]} vs {want[0]}"
    if got[1] == want[1]:
        return "ok", len(got[1]), took, ""
    a, b = set(got[1]), set(want[1])
    return "DIFF", len(got[1]), took, f"rows {len(got[1])} vs {len(want[1])}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    from shelfspark.plans.registry import entries
    from shelfspark.session import get_spark
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "12g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="check-"),
                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, (fn, sql) in entries().items():
        if args and name not in args and not any(a.endswith("*") and name.startswith(a[:-1]) for a in args):
            continue
        try:
            state, n, took, note = compare(spark, con, folder, fn, sql)
        except Exception as e:  # report and go on with the next query
            state, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += state not in ("ok", "rows-only")
        print(f"{state:9} {name:28} rows={n:<7} {took:6.2f}s {note[:1200]}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
