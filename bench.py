"""Time the headline reports; prints one JSON line.

BENCH_SF_DIR names the data directory, BENCH_CPUS the local cores. Without arguments the
headline reports run; ``all`` times every report; other arguments name reports.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwops.reports import REPORTS
from dwops.session import build_session

HEADLINE = [
    "nation_year_revenue", "star_join", "group_agg", "cohort_retention", "daily_summary", "mom_growth", "yoy_join", "latest_per_key",
    "row_number", "ntile", "running_total_rows", "sessionize", "percent_rank", "moving_avg_range", "filtered_window", "scd2_history",
    "scd2_asof_join", "scd2_apply", "summary_refresh", "interval_overlap", "sequence_gaps", "profile_orders", "verify_join", "discover_joins",
    "search_objects", "tag_terms", "hierarchy_walk", "lineage_upstream",
]
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    args = sys.argv[1:]
    names = list(REPORTS) if args == ["all"] else args or HEADLINE
    spark = build_session(f"local[{cpus}]", "dwops-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="dwops-bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        REPORTS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    repeats = int(os.environ.get("BENCH_REPEATS", REPEATS))
    seconds = {}
    for name in names:
        once(name)  # warm-up
        seconds[name] = round(sorted(once(name) for _ in range(repeats))[repeats // 2], 3)
    spark.stop()
    print(json.dumps({
        "metric": f"total of {len(seconds)} reports, median of {repeats} after a warm-up", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
