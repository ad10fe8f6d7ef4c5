"""Headline queries on one table folder; prints one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the cores. Every query is run in full into a sink that
drops the rows. The graph that queries share is built and written inside the first of them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from codeskein.plans import suite_sources, suite_store  # noqa: F401
from codeskein.plans.suite import SUITE
from codeskein.session import local_session

HEADLINE = (
    "a1_totals",
    "a2_type_counts",
    "a5_complexity",
    "a6_pagerank_five_steps",
    "f3_name_contains",
    "j2_edges_with_far_node",
    "j3_file_symbols",
    "j6_resolved_references",
    "t1_related",
    "t2_callers",
    "t5_subclasses",
    "k1_nearest",
    "k1_nearest_by_words",
    "i5_hybrid",
    "k6_hybrid_context",
    "u5_edges_without_go_files",
    "w1_debounced_events",
    "a4_change_counts",
    "w1_streamed_bursts",
    "s8_store_changes",
    "k1_collection_search",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "codeskein-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        SUITE[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(Path(folder).name.removeprefix("sf") or 0),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
