"""Wall time of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from statistics import median

from bidlake import catalog
from bidlake.session import build_session

HEADLINE = [
    "directory_domains", "directory_tenders", "admin_kpis", "error_categories", "outcome_buckets", "pipeline_by_strategy", "pipeline_by_platform", "pipeline_by_attempts",
    "job_rollup", "url_types", "url_strategy_order", "batch_forecast", "leaderboard", "consensus_recall", "snapshot_delta", "content_dedup", "throughput_60s", "chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = catalog.queries(), {}
    for name in [n for n in HEADLINE if n in known]:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
