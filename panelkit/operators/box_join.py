"""Pairs of boxes that lie within a distance, by splitting both sides of the join level by level.

A node is a set of boxes with its bounding box.  Every round each node of more than ``LEAF`` boxes is split
at the means of its ``SPLIT_DIMS`` widest coordinates (all coordinates take part, the widest first), and a
pair of nodes goes on as the pairs of its children whose bounding boxes are within the distance.  At the end
only boxes of near leaves are compared.  No round collects a node: bounding boxes are partial aggregates by
(node, coordinate), and a pair meets at most 2**SPLIT_DIMS children on each side.

The work follows the number of near pairs of nodes, so it is linear where a box has a bounded number of
neighbours.  In data without structure in many dimensions nothing can be ruled out, and leaves meet leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import BROADCAST_ROWS, materialise

LEAF, SPLIT_DIMS = 16, 4


def sum_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def _sides(lo, hi) -> Column:
    return F.zip_with(lo, hi, lambda l, h: F.struct(l.alias("l"), h.alias("h")))


def box_min2(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared smallest distance between two boxes."""
    gaps = F.zip_with(_sides(lo_a, hi_a), _sides(lo_b, hi_b),
                      lambda a, b: F.greatest(F.lit(0.0), b["l"] - a["h"], a["l"] - b["h"]))
    return sum_of(F.transform(gaps, lambda c: c * c))


def box_max2(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared largest distance between two boxes."""
    spans = F.zip_with(_sides(lo_a, hi_a), _sides(lo_b, hi_b),
                       lambda a, b: F.greatest(F.abs(b["h"] - a["l"]), F.abs(a["h"] - b["l"])))
    return sum_of(F.transform(spans, lambda c: c * c))


def _small(df: DataFrame, d: int) -> DataFrame:
    """A stored table with ``d`` numbers a row, broadcast when rows times numbers are few."""
    table = materialise(df)
    return F.broadcast(table) if table.count() * max(d, 1) <= BROADCAST_ROWS else table


def _nodes(boxes: DataFrame) -> DataFrame:
    """Per node: number of boxes ``m``, bounding box, and per coordinate the spread and mean of the low ends."""
    sides = boxes.select("node", F.posexplode(_sides(F.col("lo"), F.col("hi"))).alias("dim", "s"))
    per = sides.groupBy("node", "dim").agg(
        F.count(F.lit(1)).alias("m"), F.min("s.l").alias("l"), F.max("s.h").alias("h"),
        (F.max("s.l") - F.min("s.l")).alias("spread"), F.avg("s.l").alias("mean"))
    rows = per.groupBy("node").agg(F.max("m").alias("m"), F.array_sort(F.collect_list(
        F.struct("dim", "l", "h", "spread", "mean"))).alias("c"))  # one entry a coordinate
    widest = F.slice(F.sort_array(F.filter(F.transform("c", lambda x: F.struct(
        x["spread"].alias("spread"), x["dim"].alias("dim"), x["mean"].alias("mean"))), lambda x: x["spread"] > 0), False), 1, SPLIT_DIMS)
    return rows.select("node", F.transform("c", lambda x: x["l"]).alias("lo"), F.transform("c", lambda x: x["h"]).alias("hi"),
                       F.when(F.col("m") > LEAF, widest).otherwise(F.slice(widest, 1, 0)).alias("cuts"))


def near_leaves(boxes: DataFrame, within2: float, d: int) -> tuple[DataFrame, DataFrame]:
    """The boxes ``(key, lo, hi, node)`` with their leaf, and the pairs ``(a, b)`` of leaves (a leaf with
    itself included) whose bounding boxes are near."""
    limit = F.lit(float(within2))
    boxes = materialise(boxes.select("key", "lo", "hi", F.lit("").alias("node")))
    nodes = _small(_nodes(boxes), 2 * d)
    pairs = boxes.sparkSession.createDataFrame([("", "")], "a STRING, b STRING")
    while nodes.where(F.size("cuts") > 0).limit(1).count():
        side = F.transform("cuts", lambda c: F.when(F.element_at(F.col("lo"), c["dim"] + 1) > c["mean"], "1").otherwise("0"))
        moved = boxes.join(nodes.select("node", "cuts"), "node").select(
            "key", "lo", "hi", F.col("node").alias("parent"),
            F.when(F.size("cuts") > 0, F.concat("node", F.lit("."), F.concat_ws("", side))).otherwise(F.col("node")).alias("node"))
        boxes = materialise(moved.drop("parent"))
        nodes = _small(_nodes(boxes), 2 * d)
        # a child's parent is itself, or its name without the last part
        part = F.regexp_replace("node", r"\.[01]+$", "")
        old = pairs.select(F.col("a").alias("parent")).union(pairs.select(F.col("b").alias("parent"))).distinct()
        own = nodes.select("node", "lo", "hi")
        kids = (own.withColumn("parent", F.col("node")).join(old, "parent", "left_semi")
                .unionByName(own.withColumn("parent", part).where("parent <> node").join(old, "parent", "left_semi")))
        kids = _small(kids, 2 * d)
        left = kids.select(F.col("parent").alias("a"), F.col("node").alias("x"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        right = kids.select(F.col("parent").alias("b"), F.col("node").alias("y"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        pairs = materialise(pairs.join(left, "a").join(right, "b").where("a <> b OR x <= y")
                            .where(box_min2(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb")) <= limit)
                            .select(F.col("x").alias("a"), F.col("y").alias("b")))
    return boxes, pairs


def near_pairs(boxes: DataFrame, within2: float, d: int) -> DataFrame:
    """Pairs ``(ka, kb)`` of different boxes ``(key, lo, hi)`` whose squared distance is at most ``within2``;
    each unordered pair once, ``ka < kb``.  Keys are unique; ``d`` is the number of coordinates."""
    boxes, pairs = near_leaves(boxes, within2, d)
    left = boxes.select(F.col("node").alias("a"), F.col("key").alias("k1"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    right = boxes.select(F.col("node").alias("b"), F.col("key").alias("k2"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    return (pairs.join(left, "a").join(right, "b").where("a <> b OR k1 < k2")
            .where(box_min2(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb")) <= F.lit(float(within2)))
            .select(F.least("k1", "k2").alias("ka"), F.greatest("k1", "k2").alias("kb")))
