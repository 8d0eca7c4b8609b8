"""Physical-plan audit of every registered query.

Prints, per query, the count of shuffles and joins by strategy and flags
operators that do not scale: cartesian products, broadcast nested-loop
joins, sort-based aggregates and Python evaluation.

Usage: python tools/plan_audit.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnlens.plans.queries import QUERIES  # noqa: E402
from churnlens.session import local_session  # noqa: E402

WATCH = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
         "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "HashAggregate", "ObjectHashAggregate",
         "SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
         "Window"]
BAD = {"CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "BatchEvalPython", "ArrowEvalPython"}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8, 8)
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = {w: len(re.findall(r"(?<![A-Za-z])" + re.escape(w) + r"\b", plan)) for w in WATCH}
        shown = {k: v for k, v in counts.items() if v}
        flag = "  <-- " + ", ".join(k for k in shown if k in BAD) if any(k in BAD for k in shown) else ""
        print(f"{name}: {shown}{flag}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
