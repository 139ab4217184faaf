"""Run registered queries next to their SQL and compare all rows.

    python tests/oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if type(v).__name__ == "Decimal" else v


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, row count and all values agree, else what differs."""
    names = sorted(df.columns)
    got = _sorted(tuple(r[n] for n in names) for r in df.collect())
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != names:
        return f"columns {names} != {sorted(have)}"
    order = [have.index(n) for n in names]
    want = _sorted(tuple(r[i] for i in order) for r in cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lexiloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = run(spark, folder)
            sql = entry.oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else None
            note = "" if sql else f" (rows only: {df.count()})"
        except Exception as e:
            problem, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s{note} {problem or ''}", flush=True)
    print(f"{failed} failed")
