"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query is first run once (warm-up pass over all of them), then each is
timed ``$BENCH_RUNS`` times (default 3) with its full result materialised
through the ``noop`` sink (no driver collect); the median is reported.
Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [name ...]
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_agg_ledger", "q_agg_dashboard", "q_agg_invoice", "q_join_invoice", "q_join_pay_chain", "q_run_reminders",
    "q_apply_charges", "q_settle_callbacks", "q_settle_idempotent", "q_ingest_registrations", "q_fk_check",
    "q_join_ticket_owner", "q_scope_rows", "q_top_current_bill", "q_agg_notify_result", "q_build_outbox",
    "q_delete_cascade", "q_upsert_usage", "q_agg_amount_reconcile", "q_topk_notifications",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    from meterbook.plans.registry import load_all
    from meterbook.session import build_session
    spark = build_session(f"local[{cpus}]", max(8, 2 * cpus), app_name="meterbook-bench",
                          extra={"spark.driver.memory": "16g",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-")})
    reg = load_all()
    names = sorted(reg) if "--all" in sys.argv else HEADLINE
    if args:
        names = [n for n in names if any(a in n for a in args)]
    times: dict[str, float] = {}

    def run(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    ok = []
    for name in names:                      # warm-up pass over every query (JIT, file caches)
        try:
            run(name)
            ok.append(name)
        except Exception as e:  # noqa: BLE001
            print(f"# {name} failed: {str(e)[:200]}", file=sys.stderr)
    for name in ok:
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
