"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_ALL=1 times every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.session import local_session  # noqa: E402
from suite import load_all  # noqa: E402
from suite.registry import QUERIES  # noqa: E402

HEADLINE = (
    "flagship_regional_revenue_chart", "a1_b4_a10_import", "b2_b3_inference", "c4_deduplicate", "c8_recipe_execute",
    "c12_aggregate", "c20_join", "c22_outliers_zscore", "d1_d4_field_profile_lineitem", "d5_d7_dataset_profile",
    "d6_duplicate_rows", "d8_summary_statistics", "e3_run_regional_revenue", "e12_join_inner", "e13_aggregation",
    "e15_windows", "f1_row_id_by_keys", "f1_renumber", "f2_page", "g1_chart_sum", "g10_dashboard_charts",
    "h2_trace_upstream", "k1_incremental_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    cold: dict[str, float] = {}
    seconds: dict[str, float] = {}
    for name in names:
        for times in (cold, seconds):  # the first run compiles, the second counts
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, cold[name], seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "warm wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_run": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
