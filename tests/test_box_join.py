"""Near pairs of boxes against brute force, and how the compared pairs grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators.box_join import near_leaves, near_pairs


def _frame(spark, lo, hi):
    rows = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(lo, hi))]
    return spark.createDataFrame(rows, "key BIGINT, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>")


@pytest.mark.parametrize("dims,within", [(2, 0.05), (6, 0.4), (20, 1.2)])
def test_near_pairs_equal_brute_force(spark, dims, within):
    rng = np.random.default_rng(dims)
    lo = np.concatenate([rng.uniform(0, 1, (250, dims)), np.repeat(rng.uniform(0, 1, (1, dims)), 40, axis=0)])
    hi = lo + rng.uniform(0, 0.05, lo.shape)
    gap = np.maximum(0, np.maximum(lo[None] - hi[:, None], lo[:, None] - hi[None]))
    near = (gap ** 2).sum(-1) <= within ** 2
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    got = [tuple(r) for r in near_pairs(_frame(spark, lo, hi), within ** 2, dims).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_boxes(spark):
    assert near_pairs(_frame(spark, [], []), 1.0, 3).count() == 0


def test_compared_pairs_grow_with_the_boxes(spark):
    """6-D clusters of 20 points in a space that grows with their number: compared pairs a point stay flat."""
    per_point = []
    for clusters in (50, 400):
        rng = np.random.default_rng(clusters)
        side = clusters ** (1 / 6) * 10
        x = np.repeat(rng.uniform(0, side, (clusters, 6)), 20, axis=0) + rng.normal(0, 0.3, (clusters * 20, 6))
        boxes, pairs = near_leaves(_frame(spark, x, x), 1.0, 6)
        m = boxes.groupBy("node").count()
        n = (pairs.join(m.select(F.col("node").alias("a"), F.col("count").alias("x")), "a")
             .join(m.select(F.col("node").alias("b"), F.col("count").alias("y")), "b").agg(F.sum(F.expr("x * y"))).first()[0])
        per_point.append(n / len(x))
    print("compared pairs a point", per_point)
    assert per_point[1] < 2 * per_point[0]
