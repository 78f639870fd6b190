"""Compare registered queries with their SQL on DuckDB.

Usage: python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 4) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _apart(names, columns, got, want):
    """Rows without a partner, floats compared by tolerance and everything else exactly."""
    def split(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        groups: dict = {}
        for r in rows:
            cells = [r[i] for i in order]
            key = tuple("float" if isinstance(v, float) else _cell(v) for v in cells)
            groups.setdefault(key, []).append([v for v in cells if isinstance(v, float)])
        return groups

    a, b, bad = split(columns, got), split(names, want), []
    for key in a.keys() | b.keys():
        left, right = list(a.get(key, [])), list(b.get(key, []))
        for x in left:
            near = next((y for y in right if all(math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5) or math.isnan(p) and math.isnan(q)
                                                 for p, q in zip(x, y))), None)
            if near is None:
                bad.append(((key, x), None))
            else:
                right.remove(near)
        bad += [(None, (key, y)) for y in right]
    return bad


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = canonical(df.columns, got), canonical(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        # floats that lie on a rounding border may have been sorted or printed apart
        diff = _apart(names, df.columns, got, want)
    return f"{len(diff)} of {len(a)} rows differ, first: {diff[0][0]} against {diff[0][1]}" if diff else None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("plantlens")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from plantlens.queries import ALL

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(args.sf), 0
    for q in ALL:
        if args.names and not any(q.name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = q.run(spark, args.sf)
            message = compare(df, con, q.sql) if q.sql else f"{len(df.collect())} rows (no SQL)"
            ok = message is None or not q.sql
        except Exception as exc:  # report and go on
            message, ok = f"{type(exc).__name__}: {str(exc)[:1500]}", False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q.name:28s} {time.time() - start:6.2f}s {message or ''}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
