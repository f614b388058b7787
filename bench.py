"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3):
one warm-up, then the median of the runs. Results go to the noop sink, which computes every
column of every row and keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from firmaforge.session import build_session  # noqa: E402
from queries.all import QUERIES  # noqa: E402

HEADLINE = [
    "bronze_places",
    "bronze_incremental_upsert",
    "silver_unify",
    "gold_segments",
    "gold_metrics_union",
    "analytics_summary",
    "norm_name",
    "pii_detect",
    "pii_mask",
    "compliance_report",
    "quality_suite",
    "page_keywords",
    "facets_topk",
    "high_value",
    "search_index_build",
    "search_bm25",
    "search_fuzzy",
    "er_matches",
    "er_components",
    "upsert_merge",
    "scd2_history",
    "lookup_enrich",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries (median per query)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
