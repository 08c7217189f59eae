"""Run queries on Spark and their SQL on DuckDB over the same tables and compare the rows: python check_oracles.py [names]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import threading
import time

import duckdb

from crosswalk.session import local_session
from workload import ORACLES, QUERIES

LIMIT_SECONDS = 60
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        watch = threading.Timer(LIMIT_SECONDS, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        watch.start()
        try:
            df = fn(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in ORACLES:
                print(f"{name:32s} rows={len(got)} {took:.1f}s (no SQL)", flush=True)
                continue
            start = time.time()
            cur = con.execute(ORACLES[name])
            columns = [d[0] for d in cur.description]
            want = rows_of(columns, cur.fetchall())
            same = sorted(columns) == sorted(df.columns) and got == want
            print(f"{name:32s} {'ok  ' if same else 'DIFF'} rows={len(got)}/{len(want)} {took:.1f}s sql {time.time() - start:.1f}s",
                  flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns), sorted(columns))
                a, b = set(got), set(want)
                print("   spark only", [x for x in got if x not in b][:3])
                print("   sql only  ", [x for x in want if x not in a][:3], flush=True)
        except Exception as problem:  # report and go on with the next query
            bad += 1
            print(f"{name:32s} FAIL after {time.time() - start:.0f}s {str(problem)[:600]}", flush=True)
        finally:
            watch.cancel()
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    sys.exit(main(folder, [a for a in args if not a.startswith("/")]))
