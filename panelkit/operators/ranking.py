"""Global positions without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
Here the frame is sorted with a range exchange (hot keys are split across
partitions by the sampled bounds), written to the shared checkpoint folder so
that both passes see the same partitions, and each row's position is its
partition's offset (a prefix sum over one row per partition, bounded by the
partition count) plus its rank inside the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import bounded_collect, join_on, small_side
from panelkit.session import ensure_checkpoint_dir


def with_global_index(df: DataFrame, order_cols: list, name: str = "idx",
                      group_cols: list[str] | None = None) -> DataFrame:
    """0-based position in the order given by ``order_cols``; with
    ``group_cols`` (which must lead ``order_cols``) the position restarts in
    every group (a null group is a group)."""
    ensure_checkpoint_dir(df.sparkSession)
    sorted_df = (df.orderBy(*order_cols)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id())
                 .checkpoint(eager=True))
    # One row per partition (bounded by the partition count): prefix sums of
    # the partition sizes are taken on the driver and broadcast back.
    n_parts = sorted_df.rdd.getNumPartitions()
    per_part = bounded_collect(
        sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first")),
        n_parts, "partition sizes")
    rows, running = [], 0
    for r in sorted(per_part, key=lambda r: r["_pid"]):
        rows.append((int(r["_pid"]), int(r["_first"]), running))
        running += int(r["_cnt"])
    offsets = df.sparkSession.createDataFrame(rows, "_pid INT, _first BIGINT, _off BIGINT")
    out = (sorted_df.join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first")))
    if group_cols:
        starts = out.groupBy(*group_cols).agg(F.min(name).alias("_gstart"))
        out = join_on(out, small_side(starts), group_cols).withColumn(name, F.col(name) - F.col("_gstart")).drop("_gstart")
    return out.drop("_pid", "_mid", "_first", "_off")
