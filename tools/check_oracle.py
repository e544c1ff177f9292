"""Compare every registered Spark query with its DuckDB twin (dev aid).

Row count, column names (sorted) and an order-insensitive multiset of
normalised rows, as the correctness gate does.
"""
import datetime as dt
import decimal
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
import duckdb  # noqa: E402

from panelkit.catalog import registered  # noqa: E402
from panelkit.oracle import oracle_sql  # noqa: E402
from panelkit.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    spark = get_spark("local[8]")
    qs, sqls = registered(), oracle_sql()
    ok = bad = 0
    for k, f in qs.items():
        if only and k not in only:
            continue
        if k not in sqls:
            print(f"---- {k}: no oracle")
            continue
        t = time.time()
        try:
            sdf = f(spark, sf)
            scols = sdf.columns
            srows = [tuple(norm(r[c]) for c in sorted(scols)) for r in sdf.collect()]
            res = con.execute(sqls[k])
            dcols = [d[0] for d in res.description]
            drows_raw = res.fetchall()
            order = sorted(range(len(dcols)), key=lambda i: dcols[i])
            drows = [tuple(norm(r[i]) for i in order) for r in drows_raw]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {k}: {type(e).__name__}: {str(e)[:400]}")
            continue
        msg = []
        if sorted(scols) != sorted(dcols):
            msg.append(f"cols spark-only={sorted(set(scols)-set(dcols))} sql-only={sorted(set(dcols)-set(scols))}")
        if len(srows) != len(drows):
            msg.append(f"rows {len(srows)} vs {len(drows)}")
        elif sorted(srows, key=key) != sorted(drows, key=key):
            a, b = sorted(srows, key=key), sorted(drows, key=key)
            diffs = [(x, y) for x, y in zip(a, b) if x != y]
            msg.append(f"values differ in {len(diffs)} rows; first: spark={diffs[0][0]} sql={diffs[0][1]}")
        if msg:
            bad += 1
            print(f"FAIL {k}: {'; '.join(msg)[:700]}")
        else:
            ok += 1
            print(f"OK   {k} ({len(srows)} rows, {time.time()-t:.1f}s)")
    print(f"summary ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
