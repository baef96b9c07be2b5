"""Facts about a DataFrame's physical plan (what ``explain`` shows), for
tests and for checking that a plan is the intended one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The plan's text in full: long schemas and filters are not cut short."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields")}
    try:
        for k in before:
            conf.set(k, "1000000")
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def plan_facts(df: DataFrame) -> dict:
    """Counts of the operators that matter at scale in the (initial,
    pre-AQE) physical plan."""
    p = physical_plan(df)
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", p)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", p)),
        "single_partition_exchanges": len(re.findall(r"Exchange SinglePartition", p)),
        # ... other than the final step of a global aggregate or a limit, whose
        # input is already one partial row / a bounded number of rows per task
        "unreduced_single_partition": _unreduced_single_partition(p),
        "broadcast_joins": len(re.findall(r"BroadcastHashJoin", p)),
        "sort_merge_joins": len(re.findall(r"SortMergeJoin", p)),
        "cartesian": len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", p)),
        "python_udf": len(re.findall(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|MapInArrow|FlatMapGroupsInArrow", p)),
        "windows": len(re.findall(r"\bWindow\b", p)),
        "take_ordered": len(re.findall(r"TakeOrderedAndProject", p)),
        "pushed_filters": re.findall(r"PushedFilters: \[([^\]]*)\]", p),
        "read_schemas": re.findall(r"ReadSchema: (struct<[^>]*>)", p),
    }


def _unreduced_single_partition(plan: str) -> int:
    lines = plan.splitlines()
    n = 0
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            if "partial_" not in nxt and "LocalLimit" not in nxt and "TakeOrderedAndProject" not in nxt:
                n += 1
    return n
