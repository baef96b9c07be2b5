"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import ensure_checkpoint_dir, scratch_path

# Row bound under which a derived lookup table (one row per group, per
# cluster, per file ...) is broadcast.  Above it the join stays a shuffle join.
BROADCAST_ROWS = 500_000


def materialise(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared checkpoint folder and continue
    from there: the table is computed once, its lineage is cut (a lost
    executor does not recompute the plan behind it), and joining it back to
    the data it came from cannot trigger a recomputation (a cached plan is
    not matched any more once Spark re-aliases one side of such a join)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Plan nodes that cost about as much to run again as to read back.
PLAIN_NODES = {"Project", "Filter", "Expand", "Generate", "Union", "LogicalRelation", "LocalRelation", "LogicalRDD", "RelationV2",
               "DataSourceV2ScanRelation"}


def is_plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads, projects and filters."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in PLAIN_NODES:
            return False
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return True


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself when it is a plain scan; otherwise written once as Parquet below the shared checkpoint folder
    and read from there, so that several passes do not run the plan behind it several times."""
    return df if is_plain_scan(df) else written(df, "input")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids and labels that one task takes at least, and the tasks that a small table keeps.
ROWS_A_TASK, LEAST_TASKS = 1 << 16, 8


def in_few(df: DataFrame, rows: int, rows_a_task: int | None = None) -> DataFrame:
    """``df`` in no more partitions than its ``rows`` counted rows need.  What follows an exchange has a task for every
    shuffle partition; each task writes three files and a log entry to the next exchange, which for small
    tables is far more than the rows.  Partitions are merged where they are, nothing is shuffled."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // (rows_a_task or ROWS_A_TASK))))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a per-group table once and broadcast it only when its row
    count is proven to be within ``max_rows``; otherwise return it for an
    ordinary (shuffle) join."""
    table = materialise(df)
    n = table.count()
    return F.broadcast(table) if n <= max_rows else table


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table whose size is bounded by a parameter (k centroids,
    requested variables ...); refuse when the bound does not hold."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect")
    return rows


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null keys match each other (a null period
    is a group like any other).  The right side's key columns are dropped,
    as with ``join(..., on=keys)``; a broadcast hint on ``right`` is kept."""
    keys = list(keys)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    return out.drop(*[f"__r_{k}" for k in keys])
