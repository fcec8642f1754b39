"""Headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores). Every query runs twice into a sink that takes
all rows and keeps none; ``queries`` has the second times, ``first_runs`` the first.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline import session  # noqa: E402
from plumbline.plans import catalog  # noqa: E402

HEADLINE = [
    "b3_message_islands", "c1_content_tokens", "d1_nano_score", "d2_eleven_features", "d3_fifteen_features", "d14_prefix_scores",
    "e2_confident_wrong", "e7_adapters", "f4_chain_score", "f10_stream_guard", "f18_rank_blend", "f19_knn_risk", "f20_knn_thresholds",
    "h1_conformal_threshold", "h2_auroc", "h6_precision_at_fpr", "h10_mesh", "h19_lifecycle", "i2_stability_index", "i3_drift_events",
    "i7_adaptive_thresholds", "i9_suppressed_alerts", "i10_guardrails", "j1_recent_chains", "j2_domain_rollup", "j3_time_series",
    "j18_period_metrics", "a8_feedback_upsert", "a16_monitor_history", "k3_sign", "k4_verify", "k6_verify_hops",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    cold, times = {}, {}
    for name in names:
        for into in (cold, times):  # the first run also compiles code and writes the views it needs
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - t0, 3)
    chains = spark.read.parquet(f"{base}/events.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_runs": cold,
                      "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"), "scored_chains": chains,
                      "chains_signed_per_sec": round(chains / times["k3_sign"]) if "k3_sign" in times else None}))


if __name__ == "__main__":
    main()
