"""Print, per registered query, the count of plan operators that matter at
scale (cartesian / nested-loop joins, Python evaluation, single-partition
exchanges, join strategies).

Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from finlens.session import build_session  # noqa: E402

WATCH = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
         "SinglePartition", "SortMergeJoin", "BroadcastHashJoin"]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def audit(spark, sf_dir: str) -> dict[str, dict[str, int]]:
    from finlens.plans import all_queries

    out = {}
    for name, q in sorted(all_queries().items()):
        plan = q.build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        out[name] = {p: len(re.findall(p, plan)) for p in WATCH}
    return out


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    s = build_session("local[8]", shuffle_partitions=8)
    for q, counts in audit(s, sf).items():
        print(f"{q:28s} {({k: v for k, v in counts.items() if v})}")
