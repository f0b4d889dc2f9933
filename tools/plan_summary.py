"""Summarise the physical plans of headline keys (operator counts and join strategies).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shotloom.plans import registry  # noqa: E402
from shotloom.session import get_spark  # noqa: E402

KEYS = ["retrieve_jaccard", "retrieve_random", "retrieve_dot", "prompt_build", "repair_literals", "sql_edges",
        "complexity", "correction_prompt"]
OPS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobinPartitioning",
       "Exchange SinglePartition", "BroadcastExchange", "HashAggregate", "WindowGroupLimit", "Window", "Sort",
       "Generate", "MapInPandas", "FileScan parquet", "InMemoryTableScan"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    print(f"# Physical plans of headline keys ({sf}, after execution, AQE final plans)\n")
    print("Counts of operators in the executed plan; generated by `tools/plan_summary.py`.\n")
    for k in KEYS:
        df = registry.QUERIES[k](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = Counter()
        for op in OPS:
            c[op] = len(re.findall(re.escape(op), plan))
        c["Window"] -= c["WindowGroupLimit"]
        partial = plan.count("WindowGroupLimit") and "Partial" in plan
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))
        print(f"## {k}\n")
        print(", ".join(f"{op}: {n}" for op, n in c.items() if n) or "(no operators matched)")
        if partial:
            print("\npartial WindowGroupLimit before the shuffle: yes")
        if pushed and any(pushed):
            print(f"\npushed filters: {pushed}")
        print()


if __name__ == "__main__":
    main()
