"""Run registered queries next to their SQL on the same tables and compare rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "null" if value != value else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_time = time.time() - start
    if sql is None:
        return True, f"rows={sum(got.values())} (no SQL)", spark_time, 0.0
    start = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_time = time.time() - start
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", spark_time, sql_time
    if got == want:
        return True, f"rows={sum(got.values())}", spark_time, sql_time
    extra, missing = got - want, want - got
    text = f"rows {sum(got.values())} vs {sum(want.values())}; {sum(extra.values())} differ {got_cols}"
    for a in sorted(extra)[:3]:
        text += f"\n   spark {a}"
    for a in sorted(missing)[:3]:
        text += f"\n   sql   {a}"
    return False, text, spark_time, sql_time


def main():
    from tidemark import build_session
    from tidemark.plans import load

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = sys.argv[2:] or list(queries)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), []
    spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count().collect()
    for name in names:
        try:
            ok, text, a, b = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as error:
            ok, text, a, b = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0, 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} spark {a:6.2f}s sql {b:6.2f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} equal; failing: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
