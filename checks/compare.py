"""Run queries next to their SQL twins: ``python -m checks.compare [sf] [name..]``."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return bool(got), f"{name}: {len(got)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(want_columns)}"
    a, b = canonical(df.columns, got), canonical(want_columns, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{name}: {len(a)} vs {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"
    return bool(a), f"{name}: {len(a)} rows, {took:.1f}s" + ("" if a else " EMPTY")


def main() -> None:
    from checks import all_queries
    from sigweave import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, twins = all_queries()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, text = compare(spark, con, name, fn, twins.get(name), sf)
        except Exception as err:
            ok, text = False, f"{name}: {type(err).__name__} {str(err)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
