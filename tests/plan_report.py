"""Write a per-query summary of the final (AQE) physical plans to docs/PLANS.md.

Usage: python tests/plan_report.py [sf_dir]
For every registered query: shuffle exchanges, broadcast exchanges, join
strategies, windows (and WindowGroupLimit), single-partition exchanges, Python
nodes, and the columns each parquet scan reads. Runs each query once so the
adaptive plan is final: the rows are collected (they are few at sf0.01) and the plan of that same execution
is read, so counts of reused exchanges and of scans per table are those of what ran.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import get_session  # noqa: E402

COUNT = {
    "shuffle": r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange RoundRobin",
    "single_partition": r"Exchange SinglePartition",
    "broadcast": r"\bBroadcastExchange",
    "reused": r"\bReusedExchange",
    "bhj": r"\bBroadcastHashJoin",
    "smj": r"\bSortMergeJoin",
    "bnlj": r"\bBroadcastNestedLoopJoin",
    "window": r"\bWindow \[",
    "group_limit": r"\bWindowGroupLimit",
    "python": r"BatchEvalPython|ArrowEvalPython|InPandas",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from shelfwise.plans.catalog import QUERIES
    spark = get_session(master="local[4]", shuffle_partitions=8, driver_memory="8g")
    lines = ["# Physical plans (final adaptive plans)", "",
             f"Generated by `tests/plan_report.py` on `{sf}`. Counts are per query; `scans` lists the",
             "columns read from each parquet table (column pruning) and how often the table is scanned. Steps that a query",
             "writes to the scratch folder first (customer summary, ranks, forecasts, items) are executions of their own and",
             "not in these counts. Broadcast nested-loop joins have one-row sides or the stated query vectors.", "",
             "| query | shuffles | single-part | broadcasts | reused | BHJ | SMJ | BNLJ | windows | "
             "group-limit | python | scans |",
             "|---|---|---|---|---|---|---|---|---|---|---|---|"]
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        df._jdf.collectAsList()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan[:plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert "isFinalPlan=false" not in final, name
        plan = final
        c = {k: len(re.findall(v, plan)) for k, v in COUNT.items()}
        read = Counter(f"{t}({len(cols.split(','))})" for cols, t in
                       re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*?/(\w+)\.parquet\]", plan))
        scans = [f"{t}" + (f"x{n}" if n > 1 else "") for t, n in sorted(read.items())]
        lines.append(f"| {name} | {c['shuffle']} | {c['single_partition']} | {c['broadcast']} | {c['reused']} | "
                     f"{c['bhj']} | {c['smj']} | {c['bnlj']} | {c['window']} | {c['group_limit']} | "
                     f"{c['python']} | {' '.join(scans)} |")
        print(name, c, flush=True)
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    os.makedirs(os.path.dirname(out), exist_ok=True)
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
