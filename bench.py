"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.chdir(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.getcwd())

from checks.queries import REGISTERED  # noqa: E402
from promptmill.session import local_session  # noqa: E402

HEADLINE = (
    "grade_outputs", "prompt_accuracy", "tier1_chunks", "prompt_pool_asof",
    "extract_choice_strict", "extract_number", "grader_agreement", "item_outcomes", "item_result_map",
    "prompt_leaderboard", "failure_cases", "rewrite_pairs", "refinement_trace", "status_table", "status_funnel",
    "rule_requests", "merge_tree", "rule_consensus", "item_index", "subset_slice", "render_requests",
    "usage_running", "cost_report", "model_calls", "held_out_runs",
)
# Whole jobs and streams take longer and are run on request only: python bench.py full_run iterative_pools ...
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    # The first query of a session pays for starting it.
    REGISTERED["load_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            # Every column of every row is computed; nothing is collected.
            REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))


if __name__ == "__main__":
    main()
