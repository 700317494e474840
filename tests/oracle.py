"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _rows(rows, order):
    out = []
    for r in rows:
        out.append(tuple(float(f"{r[i]:.6f}") + 0.0 if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order))
    return sorted(out, key=_key)


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string if equal, else what differs."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = _rows(df.collect(), [df.columns.index(c) for c in cols])
    took = time.time() - t0
    if sql is None:
        return ("" if got else "no rows"), took, len(got)
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {sorted(names)} vs {cols}", took, len(got)
    want = _rows(cur.fetchall(), [names.index(c) for c in cols])
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", took, len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]} of {cols}", took, len(got)
    return ("" if got else "no rows"), took, len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from reelframe.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            msg, took, n = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:
            msg, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, 0
        failed += bool(msg)
        tag = "ok  " if not msg else "FAIL"
        print(f"{tag} {name:28s} {n:8d} rows {took:6.1f}s {'' if sqls.get(name) else '(rows only)'} {msg}", flush=True)
    print("failed:", failed)
