"""Runs named queries against their SQL statement: ``python tests/compare.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """Comparable form of one value; floats keep nine digits."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return tuple(plain(x) for x in v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} / {want_cols}", len(got)
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} / {len(want)}; only here {list(a - b)[:2]}; only there {list(b - a)[:2]}", len(got)
    return None, len(got)


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from gradeloom.session import build_session

    sf, names = (argv[0] if argv else "0.001"), argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            diff, n = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += diff is not None
        mark = "FAIL" if diff else ("ok" if name in oracles else "ok (rows only)")
        print(f"{mark:5} {name} rows={n} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
