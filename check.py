"""Run registered queries next to their SQL counterparts in DuckDB.

    python check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

import duckdb

from pulseframe import session
from pulseframe.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    return names, sorted(out, key=lambda t: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in t))


def compare(spark, con, name: str, folder: str) -> tuple[str, float, int]:
    t0 = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - t0
    if name not in ORACLES:
        return ("rows-only" if got else "EMPTY"), took, len(got)
    cur = con.execute(ORACLES[name])
    want = cur.fetchall()
    gc, g = _rows(df.columns, got)
    wc, w = _rows([d[0] for d in cur.description], want)
    if gc != wc:
        return f"COLUMNS {gc} != {wc}", took, len(g)
    if len(g) != len(w):
        return f"COUNT {len(g)} != {len(w)}", took, len(g)
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        close = all(
            (x == y) or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-6))
            for a, b in bad for x, y in zip(a, b)
        )
        diffs = [(n, x, y) for n, x, y in zip(gc, *bad[0]) if x != y]
        return f"{'ROUNDING' if close else 'VALUES'} {len(bad)}/{len(g)} e.g. {diffs} in {bad[0][0]}", took, len(g)
    types = [(n, type(x).__name__, type(y).__name__) for n, x, y in zip(gc, g[0], w[0]) if type(x) is not type(y) and x is not None and y is not None] if g else []
    return f"match{' TYPES ' + str(types) if types else ''}" if g else "match EMPTY", took, len(g)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = session.build("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in args.names or QUERIES:
        try:
            status, took, n = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            status, took, n = f"ERROR {type(e).__name__} {str(e)[:1500]}", 0.0, -1
            if args.names:
                traceback.print_exc()
        if not status.startswith(("match", "rows-only")):
            failed.append(name)
        print(f"{name:26s} {took:6.2f}s {n:8d} {status}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
