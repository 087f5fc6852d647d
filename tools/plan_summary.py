"""Summarise the physical plan of every registered query into PLANS.md.

For each query: shuffles (Exchange), broadcasts, join strategies, windows,
partial top-k (WindowGroupLimit), Python stages, and the parquet scans'
read schemas, from ``explain("formatted")`` at the given scale.
Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNT = ["Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "WindowGroupLimit", "HashAggregate",
         "SortAggregate", "ObjectHashAggregate", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "Generate"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from lexframe.plans.registry import queries
    from lexframe.session import get_session
    spark = get_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    jvm = spark.sparkContext._jvm
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_summary.py` at `{sf}` (`explain(\"formatted\")`, before AQE re-planning). "
          "Counts are operator nodes in the plan; `Exchange` includes broadcast exchanges. Scan columns are the "
          "`ReadSchema` field counts per parquet scan (pruning) and `PushedFilters` that reached the scan. "
          "Queries over the section table show the plan after its checkpoints (the work before a checkpoint "
          "runs when the DataFrame is built). A round-robin `Exchange` in a text query is `spread()` on a "
          "single-file test table; it is a no-op on inputs with at least as many partitions as cores.\n")
    print("| query | " + " | ".join(c for c in COUNT) + " | scans (cols) | pushed filters |")
    print("|---|" + "---|" * (len(COUNT) + 2))
    for name, fn in sorted(queries().items()):
        df = fn(spark, sf)
        plan = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        head = plan.split("\n\n")[0]
        counts = [len(re.findall(rf"[\s\-+:]{c}(?: [A-Za-z]+)* \(\d+\)", head)) for c in COUNT]
        scans = re.findall(r"ReadSchema: struct<(.*?)>\n", plan)
        cols = [str(len(re.findall(r"(?:^|,)\w+:", s))) for s in scans]
        pushed = [p for p in re.findall(r"PushedFilters: \[(.*?)\]", plan) if p]
        print(f"| `{name}` | " + " | ".join(str(c) for c in counts) + f" | {','.join(cols)} | "
              f"{'; '.join(sorted(set(pushed)))[:120]} |")


if __name__ == "__main__":
    main()
