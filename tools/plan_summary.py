"""Summarise the physical plan of every registered query.

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Reports shuffle count, join strategies, aggregates, window limits, Python
operators, and the Parquet scans' pushed filters and read schemas.  Streaming
queries are summarised from their batch read-back only.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_spark  # noqa: E402

KINDS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "WindowGroupLimit", "Expand",
         "MapInPandas", "Generate", "TakeOrderedAndProject"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    print("# Physical plan summary\n")
    print(f"Generated by `tools/plan_summary.py` at `{sf_dir}` (AQE initial plans).\n")
    print("| query | shuffles | joins | other operators | pushed filters (max per scan) | widest read schema |")
    print("|---|---|---|---|---|---|")
    for name, q in sorted(load_all().items()):
        if name.startswith("x"):
            continue
        try:
            df = q.fn(spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
        except Exception as exc:  # report and continue
            print(f"| {name} | error: {type(exc).__name__} | | | | |")
            continue
        ops = Counter()
        for k in KINDS:
            ops[k] = len(re.findall(rf"\b{k}\b", plan))
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        joins = ", ".join(f"{k}×{ops[k]}" for k in KINDS[:5] if ops[k])
        other = ", ".join(f"{k}×{ops[k]}" for k in KINDS[5:] if ops[k])
        pushed = [len([x for x in m.split(", ") if x]) for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan)]
        widths = [m.count(":") for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
        print(f"| {name} | {shuffles} | {joins or '-'} | {other or '-'} | {max(pushed) if pushed else 0} | "
              f"{max(widths) if widths else 0} |")


if __name__ == "__main__":
    main()
