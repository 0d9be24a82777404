"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rollbook.plans import registry
from rollbook.session import drop_cuts, local_session

HEADLINE = ["f2_f5_normalize_lines", "j1_voter_match", "w8_leader_dedup", "r5_duplicate_name", "a2_totals_by_cause", "w1_leaderboard",
            "a15_m7_pay_run", "st4_clock_shifts", "j6_similar_pages", "j4_same_sheet", "r8_u1_same_handwriting",
            "f24_rows_by_headers"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "rollbook-bench")
    registry.load_all()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        drop_cuts(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
