"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores; BENCH_QUERIES a comma-separated list of names instead of the
headline ones. Each query runs to the end into a no-op sink, once unmeasured
to warm up and then BENCH_RUNS times (default 1; the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "c1_list_feeds", "c7_time_range", "d1_unread", "d3_last_n", "e4_poll_activity", "f1_batch_by_gap",
    "f1_batch_by_gap_late", "f2_batch_by_span", "f2_batch_by_span_late", "f4_sample_span", "f6_batch_feed_span_count",
    "f6_batch_feed_mixed", "f7_batch_report", "f8_summary_report", "f12_split_files", "f13_join_parts", "g1_sync_merge",
    "h2_status_transitions", "h4_state_intervals", "h9_disk_alarms", "h12_counter_rates", "h13_latest_by_feed",
    "a4_read_snapshots", "i1_extract_variables", "i4_resample", "j3_content_changes", "a8_page_links",
]


def main() -> None:
    from tidewire import session
    from tidewire.catalog import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    known = registry()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",") if n in known]
    spark = session.build(f"local[{cpus}]", "bench", int(cpus), spark__driver__memory="16g")
    seconds = {}
    for name in names:
        best = None
        for run in range(runs + 1):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if run:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name:<28} {best:7.2f}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
