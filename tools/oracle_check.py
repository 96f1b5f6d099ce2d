"""Run registered queries in Spark and their DuckDB oracles; compare results.

    python tools/oracle_check.py [--sf-dir DIR] [name-substring ...]

Checks row count, column names and an order-insensitive hash of the values,
as the driver's correctness gate does.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import hashlib
import json
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck_con(sf_dir):
    import duckdb
    from meterbook.plans.oracle import RAW_TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("--conf", action="append", default=[], help="key=value session setting")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from meterbook.session import build_session
    from meterbook.plans.registry import load_all
    spark = build_session("local[8]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-")})
    for kv in a.conf:
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    reg = load_all()
    try:
        from meterbook.llm.queries import QUERIES
        reg = {**reg, **QUERIES}
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith(("meterbook.llm", "corpus_pipeline")):
            raise
    con = duck_con(a.sf_dir)
    results = {}
    for name, q in sorted(reg.items()):
        if a.names and not any(s in name for s in a.names):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, a.sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = {"status": "spark_error", "error": str(e)[:400]}
            print(f"{name:32s} SPARK ERROR {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if not q.oracle:
            results[name] = {"status": "rows_only", "rows": len(rows)}
            print(f"{name:32s} rows-only {len(rows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(q.oracle)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = {"status": "oracle_error", "error": str(e)[:400]}
            print(f"{name:32s} ORACLE ERROR {str(e)[:300]}")
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = ok_cols and len(rows) == len(orows) and h1 == h2
        results[name] = {"status": "match" if ok else "mismatch", "rows": len(rows), "oracle_rows": len(orows)}
        print(f"{name:32s} {'OK ' if ok else 'BAD'} spark={len(rows)} oracle={len(orows)} ({ts:.1f}s)"
              + ("" if ok_cols else f" cols {sorted(cols)} vs {sorted(ocols)}"))
        if not ok and ok_cols:
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:a.show]:
                print("   spark :", x[:300])
            for x in sorted(s2 - s1)[:a.show]:
                print("   oracle:", x[:300])
    bad = [n for n, r in results.items() if r["status"] not in ("match", "rows_only")]
    print(json.dumps({"checked": len(results), "bad": bad}))
    spark.stop()


if __name__ == "__main__":
    main()
