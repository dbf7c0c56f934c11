"""Spark-vs-DuckDB comparison used by the tests and by hand:

    python tests/harness.py --sf 0.01 key1 key2 ...   (no keys = all keys)

Compares row count, column names and an order-insensitive multiset of rows
(doubles rounded to 6 places, NaN treated as NULL).
"""
from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
if "/opt/oracle" not in sys.path:
    sys.path.append("/opt/oracle")

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, bool):
        return bool(v)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(t[i]) for i in order) for t in tuples], [cols[i] for i in order]


def compare(spark, con, key, builder, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = builder(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    a, ac = rows_of(scols, srows)
    b, bc = rows_of(dcols, drows)
    ok_cols = ac == bc
    ok_n = len(a) == len(b)
    ca, cb = Counter(a), Counter(b)
    ok_v = ok_cols and ca == cb
    status = "OK" if (ok_cols and ok_n and ok_v) else "FAIL"
    if verbose:
        print(f"{status:4} {key:28} rows spark={len(a)} duck={len(b)} "
              f"spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
        if not ok_cols:
            print("   cols spark:", ac, "\n   cols duck :", bc)
        elif not ok_v:
            only_a = list((ca - cb).elements())[:3]
            only_b = list((cb - ca).elements())[:3]
            for x, y in zip(only_a, only_b):
                diffs = [(c, p, q) for c, p, q in zip(ac, x, y) if p != q]
                print("   diff:", diffs[:8])
            if not only_a or not only_b:
                print("   only spark:", only_a[:2], "\n   only duck:", only_b[:2])
    return status == "OK"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    from pastcast.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    keys = args.keys or sorted(qs)
    bad = []
    for k in keys:
        if k not in os_:
            t0 = time.time()
            n = qs[k](spark, sf_dir).count()
            print(f"ROWS {k:28} rows={n} ({time.time() - t0:.1f}s, no oracle)", flush=True)
            continue
        try:
            if not compare(spark, con, k, qs[k], os_[k], sf_dir):
                bad.append(k)
        except Exception as e:  # report and continue
            print(f"ERR  {k}: {str(e)[:600]}", flush=True)
            bad.append(k)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
