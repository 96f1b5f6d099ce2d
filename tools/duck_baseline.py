"""Single-node reference timings: the headline queries' DuckDB oracle SQL at
$BENCH_SF_DIR, median of 3 warm runs (context for bench.py; the reference
itself publishes no numbers)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from bench import HEADLINE
    from meterbook.plans.registry import load_all
    from tools.oracle_check import duck_con
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = duck_con(sf_dir)
    con.execute(f"SET threads={int(os.environ.get('BENCH_CPUS', '8'))}")
    reg = load_all()
    out = {}
    for name in HEADLINE:
        sql = reg[name].oracle
        if not sql:
            continue
        con.execute(sql).fetchall()
        samples = []
        for _ in range(3):
            t = time.perf_counter()
            con.execute(sql).fetchall()
            samples.append(time.perf_counter() - t)
        out[name] = round(statistics.median(samples), 3)
    print(json.dumps({"engine": "duckdb", "value": round(sum(out.values()), 3), "queries": out}))


if __name__ == "__main__":
    main()
