"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pricelode import catalog
from pricelode.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "price_estimate_weighted_median", "price_estimate_weighted_mean", "price_estimate_by_part",
    "price_used_observations", "deals_ranked", "pricing_audit", "product_names",
    "condition_status", "listing_scope", "cheap_rejections", "candidate_state", "change_replay",
    "consecutive_known_stop", "ingest_search_records", "merge_processed", "contamination_audit",
    "observation_rebuild", "work_queue_state", "verdict_application", "review_gate",
    "work_rolling_metrics", "status_summary",
]


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()

    def run(name: str) -> None:
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    run("price_estimate_weighted_median")  # starts the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
