"""Physical-plan census of the headline queries: shuffles, broadcasts, join
strategies and partial aggregates per query, as a markdown table.

    python tools/plan_census.py [SF_DIR]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def census(text: str) -> dict[str, int]:
    phys = text.split("== Physical Plan ==")[-1]
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
                                   phys)),
        "broadcasts": phys.count("BroadcastExchange"),
        "broadcast joins": phys.count("BroadcastHashJoin"),
        "sort-merge joins": phys.count("SortMergeJoin"),
        "partial aggs": len(re.findall(r"functions=\[partial_", phys)),
        "windows": len(re.findall(r"\bWindow \[", phys)),
        "scans": phys.count("FileScan"),
    }


def main() -> None:
    from bench import HEADLINE
    from meterbook.plans.registry import load_all
    from meterbook.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16)
    reg = load_all()
    rows = []
    for name in HEADLINE:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            reg[name].build(spark, sf_dir).explain(mode="extended")
        rows.append((name, census(buf.getvalue())))
    keys = list(rows[0][1])
    print("| query | " + " | ".join(keys) + " |")
    print("| --- |" + " ---: |" * len(keys))
    for name, c in rows:
        print(f"| `{name}` | " + " | ".join(str(c[k]) for k in keys) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
