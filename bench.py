"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local parallelism.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidewatch.plans import catalog
from tidewatch.plans.dataset_queries import stored_dataset
from tidewatch.session import build_session

HEADLINE = [
    "timeline", "trajectory_motion", "trajectory_ewma", "trajectory_risk_score", "targets_12m", "model_dataset", "walk_forward_roles",
    "policy_metrics", "event_lead_times", "replay_alert_leads", "intervention_queue", "portfolio_summary",
    "governance_outcomes", "observation_intake",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="20g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    builders = catalog.builders()
    # warm-up with a real query: code is compiled and files are in memory before any timing
    builders[HEADLINE[3]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        if name == "model_dataset":  # the labelled, scored panel and both tables of the join, stored once for what follows
            start = time.time()
            stored_dataset(spark, sf_dir)
            times["stored_panel"] = round(time.time() - start, 3)
        start = time.time()
        builders[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
