"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python scripts/check_oracle.py [sf_dir] [name ...]
Rows are compared as sorted multisets after rounding floats to 6 decimals.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from recolake.plans.catalog import load_all  # noqa: E402
from recolake.session import build_session  # noqa: E402
from recolake.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, q, sf_dir):
    t0 = time.time()
    sdf = q.fn(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(norm(r[c]) for c in cols) for r in sdf.collect()]
    t1 = time.time()
    if q.oracle is None:
        return f"{q.name}: rows={len(srows)} (no oracle) spark={t1 - t0:.1f}s"
    res = con.execute(q.oracle)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    if sorted(dcols) != cols:
        return f"{q.name}: COLUMN MISMATCH spark={cols} duck={sorted(dcols)}"
    pos = [dcols.index(c) for c in cols]
    drows = [tuple(norm(r[i]) for i in pos) for r in drows_raw]
    ok = sorted(srows, key=key) == sorted(drows, key=key)
    msg = f"{q.name}: {'OK' if ok else 'MISMATCH'} spark_rows={len(srows)} duck_rows={len(drows)} spark={t1 - t0:.1f}s"
    if not ok:
        ss, dd = set(srows), set(drows)
        msg += f"\n  only spark: {sorted(ss - dd, key=key)[:3]}\n  only duck: {sorted(dd - ss, key=key)[:3]}"
    return msg


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    reg = load_all()
    bad = 0
    for name in names or list(reg):
        try:
            msg = compare(spark, con, reg[name], sf_dir)
        except Exception as e:  # report and continue
            msg = f"{name}: ERROR {type(e).__name__}: {str(e)[:600]}"
        if "OK" not in msg.split("\n")[0] and "no oracle" not in msg:
            bad += 1
        print(msg, flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
