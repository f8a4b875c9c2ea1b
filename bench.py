"""Time the headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lurelog.session import local_session  # noqa: E402
from lurelog.workload import catalog  # noqa: E402

HEADLINE = [
    "ingest_valid", "ingest_rejects", "events_dedup", "sessions", "ip_windows_5m", "ip_windows_1d",
    "top_event_types", "window_features", "baseline_alerts", "label_sample", "label_context",
    "rule_sweep", "parameter_sweep", "score_thresholds", "score_ranking", "group_medians",
    "session_tfidf", "cluster_top_terms", "password_entropy", "isolation_forest", "kmeans_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "lurelog-bench", tempfile.mkdtemp(prefix="lurelog-bench-"))
    seconds = {}
    # The curated events are written once; the queries over them show their own cost.
    start = time.perf_counter()
    catalog.events(spark, sf_dir)
    seconds["stage_events"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
