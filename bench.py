"""Benchmark: runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints ONE
JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is forced to completion with a no-op write (every row and column computed, nothing
collected to the driver). One untimed warm-up run starts the JVM and the code caches; each query
is then timed $BENCH_REPEAT times (default 2) and its best time is reported.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "attrition_history",
    "headcount_monthly_tenure",
    "latest_review",
    "risk_scores",
    "attrition_period_all",
    "attrition_by_department",
    "headcount_monthly",
    "headcount_monthly_rating",
    "growth_summary",
    "basic_kpis",
    "quality_report",
    "risk_ranking",
    "insights",
    "overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from staffline.catalog import QUERIES
    from staffline.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("attrition_history")  # warm-up, not timed
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    times = {}
    for name in HEADLINE:
        times[name] = round(min(run(name) for _ in range(repeat)), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
