"""Run registered queries on Spark and their oracle SQL on DuckDB and compare
row count, column names and an order-insensitive hash of the values.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    canon_rows = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    h = hashlib.sha256(repr(canon_rows).encode()).hexdigest()
    return cols, canon_rows, h


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from ehrflow.session import build_session
    extra = {"spark.ui.showConsoleProgress": "false"}
    if os.environ.get("ORACLE_SESSION_TZ"):          # check independence from the session time zone
        extra["spark.sql.session.timeZone"] = os.environ["ORACLE_SESSION_TZ"]
    for item in filter(None, os.environ.get("ORACLE_CONF", "").split(",")):   # k=v,k=v
        k, v = item.split("=", 1)
        extra[k] = v
    spark = build_session(extra=extra)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols, srows_c, sh = canon(sdf.columns, srows)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: spark rows={len(srows)} ({ts:.1f}s) [no oracle]")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            dcols_c, drows_c, dh = canon(dcols, drows)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb error {type(e).__name__}: {str(e)[:400]}")
            continue
        ok = scols == dcols_c and len(srows) == len(drows) and sh == dh
        if not ok:
            bad += 1
            print(f"FAIL {name}: cols_eq={scols == dcols_c} rows spark={len(srows)} duck={len(drows)} "
                  f"hash_eq={sh == dh}")
            if scols != dcols_c:
                print("   spark cols", scols)
                print("   duck  cols", dcols_c)
            else:
                sset, dset = set(srows_c), set(drows_c)
                print("   only spark:", list(sset - dset)[:3])
                print("   only duck: ", list(dset - sset)[:3])
        else:
            print(f"ok   {name}: rows={len(srows)} ({ts:.1f}s)")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
