"""Run registered queries beside their SQL in DuckDB and compare rows; ``python -m tests.oracle [key ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v!r}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, key, folder):
    """Return (ok, text) for one query."""
    from hazewell.plans import QUERIES, oracle_text, runnable

    df = runnable(key)(spark, folder)
    got = rows_of(df.columns, df.collect())
    sql = oracle_text(key)
    if sql is None:
        return True, f"rows only: {len(got)} rows"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(rel.columns)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(got), set(want)
    return False, f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}; {sorted(df.columns)}; {QUERIES[key].code}"


def run_all(spark, folder, keys, threads=6):
    """Compare many queries at once (Spark runs their jobs side by side); yields (key, ok, text, seconds)."""
    from concurrent.futures import ThreadPoolExecutor

    root = connect(folder)

    def one(key):
        t = time.time()
        try:
            ok, text = compare(spark, root.cursor(), key, folder)
        except Exception as e:  # report and go on to the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        return key, ok, text, time.time() - t

    with ThreadPoolExecutor(threads) as pool:
        yield from pool.map(one, keys)


def main(argv):
    from hazewell.plans import QUERIES
    from hazewell.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    slow = float(os.environ.get("SLOW", "20"))
    keys = [k for k, q in QUERIES.items() if not argv or k in argv or q.code.split()[0].rstrip("0123456789") in argv]
    bad = 0
    for key, ok, text, sec in run_all(spark, folder, keys, int(os.environ.get("THREADS", "6"))):
        bad += not ok
        if not ok or sec > slow or "-v" in argv:
            print(f"{'ok  ' if ok else 'FAIL'} {key} {sec:.1f}s {text}", flush=True)
    print(f"{len(keys)} queries, {bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
