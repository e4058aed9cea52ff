"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of the given tables and ``BENCH_CPUS`` the
number of local cores. Each query runs once to warm up and is then timed.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from gradeloom.plans import QUERIES
from gradeloom.session import build_session

HEADLINES = [
    "v01_run_metrics", "v02_style_metrics", "v03_result_variance", "v04_style_confound", "v05_result_review",
    "v06_complete_cases", "v07_model_metrics", "v08_model_decision_metrics", "v10_decision_by_profile",
    "c03_fair_results", "m01_call_cost", "m02_style_features", "m03_style_observations", "m04_style_fit",
    "m07_rank_models", "m12_decide_or_replay", "m14_run_summary", "m15_score_stats", "m18_run_status",
    "m19_balanced_subset", "m21_parse_verdicts", "m22_style_delta", "n02_content_hash", "n03_sync_prompts",
    "q04_detail_log", "q08_full_comparison", "q09_failure_counts", "k05_dataset_gate", "s01_live_metrics",
    "a02_append_results",
]


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("GRADELOOM_SHUFFLE", cpus if cpus.isdigit() else "8")
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        seconds(spark, sf_dir, name)
        times[name] = seconds(spark, sf_dir, name)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
