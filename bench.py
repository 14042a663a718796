"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) select data
and width. Each query is run once to warm the JVM and Python workers on the small scale,
then timed over the whole result on the full scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pulseframe import session
from pulseframe.plans import QUERIES

HEADLINE = [
    "window_triage", "window_features", "record_windows", "sliding_windows", "hrv_time_domain", "sqi_verdict",
    "robust_scale", "impute_linear", "median_detrend", "peak_candidates", "clean_ecg", "sample_entropy",
    "scrub_documents", "jitter_orders", "sanitize_table", "adc_to_mv", "vitals_carry_forward", "patient_split",
    "clinical_metrics", "fairness_multi", "wear_sessions", "quota_requested", "quota_admitted", "alert_feed_topk",
    "stream_triage", "wfdb_signals", "file_manifest",
]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    warm = os.path.join(os.path.dirname(folder), "sf0.001")
    spark = session.build("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"), "cpus": int(cpus),
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())
