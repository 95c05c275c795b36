"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). The two input tables are first
dealt into ``SPLITS`` files, so that scans run in parallel as they would over a large table.
Each query runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagoscope.session import local_session  # noqa: E402
from pagoscope.plans.queries import QUERIES  # noqa: E402

SPLITS = 8
RUNS = 3
HEADLINE = (
    "dq_failures_by_code", "dq_evaluation", "dq_summary", "dq_rule_detail", "comp_findings",
    "comp_findings_by_framework", "comp_duplicate_rows", "score_regulatory", "score_texts",
    "advisor_costs", "report_sanctions_table", "report_batch_profile", "report_key_figures",
    "io_zone_routing",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    dealt = tempfile.mkdtemp(prefix="pagoscope-bench-")
    for table in ("orders", "customer"):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.repartition(SPLITS).write.parquet(f"{dealt}/{table}.parquet")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, dealt).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "payments assessment, headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
