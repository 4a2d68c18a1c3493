"""Summarise the physical plan of every registered query (initial AQE plan).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Counts shuffles, join strategies, aggregates, windows and top-k limits per
query, and flags shapes that should never appear (Cartesian products,
nested-loop joins, sort-based aggregates, Python UDFs).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from psephos.session import build_session  # noqa: E402

from psephos.plans.catalog import QUERIES  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "BatchEvalPython", "ArrowEvalPython")


def count(pattern: str, text: str) -> int:
    return len(re.findall(pattern, text))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Physical plans of the registered queries\n\nInitial AQE plans at `{sf_dir}` (AQE may still turn a")
    print("sort-merge join into a broadcast join at run time from measured sizes).  Generated by `tools/plan_summary.py`.\n")
    print("| query | shuffles | broadcast joins | sort-merge joins | semi joins | hash aggregates | windows | group limits (partial) | scalar subqueries | scans | flags |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, q in QUERIES.items():
        p = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        flags = [b for b in BAD if b in p]
        print(
            f"| `{name}` | {count(r'Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition', p)} "
            f"| {count(r'BroadcastHashJoin', p)} | {count(r'SortMergeJoin', p)} | {count(r'LeftSemi', p)} "
            f"| {count(r'HashAggregate\(', p)} | {count(r'\bWindow \[', p)} | {count(r'WindowGroupLimit .*Partial', p)} "
            f"| {count(r'Subquery subquery', p)} | {count(r'FileScan parquet', p)} | {', '.join(flags) or 'none'} |"
        )
    spark.stop()


if __name__ == "__main__":
    main()
