"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is forced end to end with the `noop` sink (full execution, no
collection to the driver); the reported time is the best of three runs (of
one for the queries in OPTIONAL).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_spark, scale_conf  # noqa: E402

HEADLINE = [
    "a1_site_daily_stats", "m13_normalise_usage", "a2_client_top_k", "g2_score_attempts",
    "j1_location_detail", "j3_resolve_host", "j8_session_profile", "j9_note_can_edit",
    "w1_admit_uploads", "m1_merge_meta", "m2_note_history", "m7_create_accounts", "q1_check_rules",
    "q2_orphans", "t1_clean_text", "t4_unique_words", "u1_parse_user_agent", "p7_parse_route",
]
OPTIONAL = ["x1_usage_stream", "x4_note_current", "m3_apply_note_changes", "m11_merge_sites", "t2_scrub_notes", "t13_footnotes",
            "q3_duplicates"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(sf_dir) for f in files)
    spark = get_spark(f"local[{cpus}]", app_name="tessera-bench",
                      extra={"spark.driver.memory": "16g", **scale_conf(size, min_partitions=int(cpus) * 2)})
    reg = load_all()
    names = HEADLINE + [n for n in OPTIONAL if n in reg]
    timings: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(1 if name in OPTIONAL else 3):
            t0 = time.perf_counter()
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
