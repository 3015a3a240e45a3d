"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is executed in full with the no-op sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "normalized_records",
    "keys_v4",
    "block_v1",
    "block_v2",
    "block_v4",
    "blocking_recall_v4",
    "candidate_lists_v4",
    "candidate_stats_v4",
    "recall_by_key_v4",
]


def main() -> None:
    # fresh materialised stages: normalisation is paid inside the timed run
    os.environ.setdefault("MATCHBOOK_STAGE_TAG", f"bench-{time.time_ns()}")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from matchbook.session import get_session
    from matchbook.plans.catalog import QUERIES

    spark = get_session(master=f"local[{cpus}]")
    names = [n for n in HEADLINE if n in QUERIES]
    extra = os.environ.get("BENCH_QUERIES")
    if extra:
        names = [n for n in extra.split(",") if n in QUERIES]
    # warm-up, not timed: JVM class loading and JIT of the same code paths on
    # the smallest scale factor (falls back to the bench folder itself)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for n in ("scan_records", "block_v4", "blocking_recall_v4"):
        QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
