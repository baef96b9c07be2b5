"""Partitioned DBSCAN and neighbour pairs against the sequential algorithm; how the work grows."""

import numpy as np
import pytest

from panelkit.operators import dbscan as DB
from panelkit.operators import spatial

from tests.test_clustering import _np_dbscan


def _frame(spark, x, parts=3):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id BIGINT, x ARRAY<DOUBLE>").repartition(parts)


def _shapes():
    rng = np.random.default_rng(3)
    rings = [np.c_[np.cos(t), np.sin(t)] * r for r in (1.0, 2.0) for t in [rng.uniform(0, 6.28, 250)]]
    blob = rng.normal(4.0, 0.02, (300, 2))  # far denser than eps: settled in bulk
    same = np.repeat([[4.0, 4.0], [-3.0, 0.0]], 120, axis=0)
    noise = rng.uniform(-6, 6, (80, 2))
    x = np.concatenate([*rings, blob, same, noise])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("block", [8, 40, 1024])
def test_settings_equal_the_sequential_algorithm(spark, block):
    x = _shapes()
    settings = ((0.1, 3), (0.3, 5), (0.3, 40), (0.9, 4))
    report = {}
    got = {(s.eps, s.min_samples, s.id): (s.cluster, s.is_core)
           for s in DB.dbscan_settings(_frame(spark, x), settings, report=report, block=block).collect()}
    assert len(got) == len(settings) * len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for eps, least in settings:
        assert [got[eps, least, i][0] for i in range(len(x))] == list(_np_dbscan(x, eps, least))
        assert [got[eps, least, i][1] for i in range(len(x))] == list((d <= eps).sum(1) >= least)
    assert report["points"] == len(np.unique(x, axis=0)) and (block > 40 or report["bulk"] > 0)


def test_six_dimensions_and_layouts(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.uniform(0, 4, (12, 6)), 30, axis=0) + rng.normal(0, 0.15, (360, 6))
    want = list(_np_dbscan(x, 0.45, 4))
    for parts, block in ((1, 1024), (7, 32)):
        rows = DB.dbscan_settings(_frame(spark, x, parts), ((0.45, 4),), block=block).collect()
        assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == want


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, [0.1, 0.0]), (4, None), (5, [0.0]), (6, [0.0, None]), (7, [float("nan"), 0.0]),
            (8, []), (None, [0.0, 0.0]), (9, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "id BIGINT, x ARRAY<DOUBLE>")
    got = {r.id: (r.cluster, r.is_core) for r in DB.dbscan(df, 0.2, 3).collect()}
    assert got == {**{i: (0, True) for i in (1, 2, 3, 9)}, **{i: (-1, False) for i in (4, 5, 6, 7, 8)}}
    assert DB.dbscan(df.limit(0), 0.2, 3).count() == 0
    assert [tuple(r) for r in DB.dbscan(df.where("id = 4"), 0.2, 3).collect()] == [(4, -1, False)]


@pytest.mark.parametrize("dims,eps", [(2, 0.3), (8, 0.9), (20, 1.6)])
def test_neighbour_pairs(spark, monkeypatch, dims, eps):
    monkeypatch.setattr(spatial, "BLOCK", 32)
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.uniform(0, 1, (220, dims)), np.repeat(rng.uniform(0, 1, (1, dims)), 50, axis=0)])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {(i, j) for i, j in zip(*np.nonzero(d2 <= eps * eps)) if i < j}
    got = [tuple(r) for r in DB.eps_neighbours(_frame(spark, x), eps).collect()]
    assert len(got) == len(want) and {(a, b) for a, b, _ in got} == want
    assert all(abs(v - d2[a, b]) < 1e-12 for a, b, v in got)


def test_compared_pairs_stay_flat(spark):
    """Clusters of 20 points in a space that grows with their number."""
    per_point = []
    for clusters in (100, 800):
        rng = np.random.default_rng(clusters)
        x = np.repeat(rng.uniform(0, clusters ** 0.5 * 4, (clusters, 2)), 20, axis=0) + rng.normal(0, 0.2, (clusters * 20, 2))
        report = {}
        DB.dbscan_settings(_frame(spark, x), ((0.5, 4),), report=report, block=100)
        per_point.append(report["compared"])
    print("compared pairs a point", per_point)
    assert per_point[1] < 1.5 * per_point[0]


def test_rounding_does_not_decide(spark):
    """Points at exactly eps of each other, far from the origin."""
    x = np.array([[1e4 + 0.25 * i, -1e4] for i in range(40)])
    assert set(r.cluster for r in DB.dbscan(_frame(spark, x), 0.25, 2).collect()) == {0}
    assert set(r.cluster for r in DB.dbscan(_frame(spark, x), 0.25 - 1e-9, 2).collect()) == {-1}


def _sphere(n, dims=40):
    x = np.random.default_rng(n).normal(size=(n, dims))
    return x / np.sqrt((x * x).sum(1))[:, None]


def test_copies_of_a_point_stay_bounded_where_all_leaves_are_near(spark):
    from panelkit.operators.common import materialise
    copies = []
    for n in (800, 3200):
        rows = [(i, 1, [float(v) for v in p]) for i, p in enumerate(_sphere(n))]
        pts = spark.createDataFrame(rows, "idx BIGINT, w BIGINT, x ARRAY<DOUBLE>")
        made = spatial.blocks(pts, n, 40, [1.1], materialise, 32)
        copies.append(made.deal(made.points).count() / n)
    assert max(copies) < 1.5 * spatial.COPIES


def test_many_dimensions_in_grown_blocks(spark):
    x = _sphere(900)
    settings = ((1.0, 3), (1.1, 6))
    rows = DB.dbscan_settings(_frame(spark, x), settings, block=16).collect()
    for eps, least in settings:
        assert [c for _, c in sorted((r.id, r.cluster) for r in rows if r.eps == eps)] == list(_np_dbscan(x, eps, least))
