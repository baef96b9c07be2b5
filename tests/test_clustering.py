"""PCA, KMeans, silhouette and DBSCAN against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import dbscan as DB
from panelkit.operators import kmeans as KM
from panelkit.operators import reduce as RD
from panelkit.operators import silhouette as SI
from panelkit.sources import tables as T

from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def vec(spark):
    v = T.vectors(spark, SF_MID)
    rows = sorted(v.collect(), key=lambda r: r.vec_id)
    X = np.array([r.embedding for r in rows])
    return v, X, np.array([r.label for r in rows]), np.array([r.vec_id for r in rows])


def _np_pca(X, k):
    C = X - X.mean(0)
    _, _, vt = np.linalg.svd(C, full_matrices=False)
    comps = vt[:k].T
    for j in range(k):
        if comps[np.argmax(np.abs(comps[:, j])), j] < 0:
            comps[:, j] *= -1
    return C @ comps


def test_pca_matches_svd(spark, vec):
    v, X, _, ids = vec
    m = RD.array_matrix(v, "embedding", keep=("vec_id",))
    s = RD.pca_scores(m, 6, keep=("vec_id",)).orderBy("vec_id").collect()
    got = np.array([[r[f"pc{j + 1}"] for j in range(6)] for r in s])
    assert np.allclose(got, _np_pca(X, 6), atol=1e-6)
    assert np.allclose(got.mean(0), 0, atol=1e-9)


def test_kmeans_labels_nearest_and_cost(spark, vec):
    v, X, _, _ = vec
    m = RD.array_matrix(v, "embedding", keep=("vec_id",))
    model = KM.kmeans_fit(m, 5, 42, "features")
    C = np.array(model.clusterCenters())
    lab = model.transform(m).orderBy("vec_id").select("cluster").collect()
    lab = np.array([r.cluster for r in lab])
    d = ((X[:, None, :] - C[None, :, :]) ** 2).sum(-1)
    assert (lab == d.argmin(1)).all()
    assert KM.model_inertia(model, m, "features") == pytest.approx(d.min(1).sum(), rel=1e-9)
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(C)],
                                  "cluster INT, centre ARRAY<DOUBLE>")
    fixed = KM.assign_fixed_centroids(v, cents, "embedding", keep=("vec_id",)).orderBy("vec_id").collect()
    assert [r.cluster for r in fixed] == list(lab)


def test_elbow_cost_decreases(spark, vec):
    v, _, _, _ = vec
    m = RD.array_matrix(v, "embedding", keep=("vec_id",))
    e = sorted(KM.elbow_curve(m, range(2, 6), 42, "features").collect())
    costs = [r.inertia for r in e]
    assert all(b <= a * 1.05 for a, b in zip(costs, costs[1:]))


def test_silhouette_matches_distance_matrix(spark, vec):
    v, X, lab, ids = vec
    got = {r.vec_id: r.silhouette for r in SI.silhouette_samples(v, "embedding", "label", keep=("vec_id",)).collect()}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    for i in range(0, len(X), 7):
        own = lab == lab[i]
        n_own = own.sum()
        a = D[i, own].sum() / (n_own - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s = 0.0 if n_own == 1 else (b - a) / max(a, b)
        assert got[ids[i]] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("block_bytes", [16 << 20, 400])
def test_euclidean_silhouette_matches_distance_matrix(spark, vec, block_bytes):
    """Also with the sample in several blocks; nulls, equal points, a lone point and another id type."""
    _, X, lab, _ = vec
    X, lab = X[:150, :5].copy(), [int(c) for c in lab[:150]]
    X[1], lab[1] = X[0], lab[0]
    lab[7] = 77  # alone in its cluster
    rows = [(f"p{i}", c, [float(v) for v in p]) for i, (p, c) in enumerate(zip(X, lab, strict=True))]
    df = spark.createDataFrame(rows + [("nul", 0, None), ("nolabel", None, [0.0] * 5)], "id STRING, c INT, x ARRAY<DOUBLE>").repartition(5)
    sample = df.where("id IN ('p0', 'p1', 'p7', 'nul', 'nolabel') OR id LIKE 'p%3'")
    got = {r.id: r.silhouette for r in SI.euclidean_silhouette(df, sample, "x", "c", "id", block_bytes).collect()}
    assert set(got) == {"p0", "p1", "p7"} | {f"p{i}" for i in range(150) if i % 10 == 3}
    lab = np.array(lab)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for name, s in got.items():
        i = int(name[1:])
        n_own = (lab == lab[i]).sum()
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        a = D[i, lab == lab[i]].sum() / (n_own - 1) if n_own > 1 else 0.0
        assert s == pytest.approx(0.0 if n_own == 1 else (b - a) / max(a, b), abs=1e-12)


def test_euclidean_silhouette_defined_cases(spark):
    df = spark.createDataFrame([(1, 3, [1.0, 2.0]), (2, 3, [1.0, 2.0])], "id LONG, c LONG, x ARRAY<FLOAT>")
    got = SI.euclidean_silhouette(df, df, "x", "c", "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 0.0), (2, 3, 0.0)]  # one cluster of equal points
    none = SI.euclidean_silhouette(df.limit(0), df.limit(0), "x", "c", "id")
    assert none.columns == ["id", "c", "silhouette"] and none.collect() == []


def test_fits_of_an_elbow_share_their_scans(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.8, (60, 2)) for m in (0.0, 2.0, 5.0)])
    df = spark.createDataFrame([([float(v) for v in p],) for p in x], "x ARRAY<DOUBLE>")
    starts = [[float(v) for v in x[i]] for i in (0, 70, 140, 10)]
    alone = {}
    for k in (1, 2, 4):
        r = {}
        centres = KM.kmeans_fits(df, {k: starts[:k]}, "x", report=r)[k]
        alone[k] = (r["scans"], centres)
    r = {}
    together = KM.kmeans_fits(df, {k: starts[:k] for k in alone}, "x", report=r)
    assert r["scans"] == max(n for n, _ in alone.values())
    for k, (_, centres) in alone.items():
        assert np.allclose(together[k], centres, atol=1e-9)


def _np_dbscan(P, eps, ms):
    d = np.sqrt(((P[:, None, :] - P[None, :, :]) ** 2).sum(-1))
    nb = [np.where(d[i] <= eps)[0] for i in range(len(P))]
    core = np.array([len(x) >= ms for x in nb])
    lab = -np.ones(len(P), int)
    c = 0
    for i in range(len(P)):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in nb[j]:
                if lab[k] == -1:
                    lab[k] = c
                    stack.append(k)
        c += 1
    return lab


def test_dbscan_matches_sequential_and_layout(spark, vec):
    v, X, _, ids = vec
    pts = v.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).alias("x"))
    want = _np_dbscan(X[:, :3], 0.05, 4)
    for frame in (pts, pts.repartition(5)):
        got = {r.id: r.cluster for r in DB.dbscan(frame, 0.05, 4).collect()}
        assert [got[i] for i in ids] == list(want)
    got = {r.id: r.cluster for r in DB.dbscan_pairs(pts, 0.05, 4).collect()}
    assert [got[i] for i in ids] == list(want)


@pytest.mark.parametrize("dims,eps,ms,limit", [(2, 0.02, 3, 4096), (2, 0.05, 5, 16), (6, 0.3, 4, 64)])
def test_cell_dbscan_refinement(spark, vec, dims, eps, ms, limit):
    from panelkit.operators.dbscan_cells import dbscan_cells
    v, X, _, ids = vec
    pts = v.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, dims).alias("x"))
    got = {r.id: r.cluster for r in dbscan_cells(pts, eps, ms, brute_limit=limit).collect()}
    assert [got[i] for i in ids] == list(_np_dbscan(X[:, :dims], eps, ms))


def test_kmeans_from_starts_ends_at_a_fixed_point(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.3, (40, 3)) for m in (0.0, 3.0, 9.0)])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "id INT, x ARRAY<DOUBLE>")
    starts = [list(map(float, x[i])) for i in (0, 41, 81)] + [[1e6] * 3]  # the last never gets a point
    centres = np.array(KM.kmeans_from(df, starts, "x"))
    near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    for c in range(3):
        assert np.allclose(centres[c], x[near == c].mean(0))
    assert np.array_equal(centres[3], [1e6] * 3)
    got = {r["id"]: r["cluster"] for r in KM.cluster_from(df, starts, "x", keep=("id",)).collect()}
    assert got == dict(enumerate(near))
    assert KM.kmeans_from(df.limit(0), starts, "x") == starts
    curve = {r["k"]: r["inertia"] for r in KM.elbow_from(df, starts, (1, 2, 3), "x").collect()}
    assert np.isclose(curve[3], ((x - centres[near]) ** 2).sum()) and curve[1] > curve[2] > curve[3]


def test_rounds_do_not_run_the_plan_behind_their_input(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 4))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([([float(v) for v in p],) for p in x], "x ARRAY<DOUBLE>").mapInArrow(count, "x array<double>")
    report = {}
    KM.kmeans_fits(df, {3: [list(map(float, p)) for p in x[:3]]}, "x", report=report)
    assert report["scans"] > 1 and seen.value == 200


def test_nearest_rows_as_summed_term_by_term():
    rng = np.random.default_rng(6)
    centres = np.concatenate([rng.integers(-3, 4, (6, 3)), [[1e6] * 3]]).astype(float)
    centres = np.concatenate([centres, centres[:2]])  # equal centres: the lowest number
    x = np.concatenate([rng.integers(-3, 4, (300, 3)) / 2, (centres[0] + centres[1])[None] / 2])  # many exact ties
    want = [min(range(len(centres)), key=lambda c: (sum((p - q) ** 2 for p, q in zip(v, centres[c], strict=True)), c)) for v in x]
    assert list(KM._nearest_rows(x, centres)) == want


def test_components_go_on_in_as_many_partitions_as_their_rows_need(spark):
    """A small graph under many shuffle partitions: a round's tables do not have a task for each of them."""
    held = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    edges = [(i, i + 3) for i in range(40) if i % 7] + [(100, 5)]
    ids = sorted({x for e in edges for x in e} | {200})
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = DB.connected_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
        assert got.rdd.getNumPartitions() <= 8
        assert {r["id"]: r["comp"] for r in got.collect()} == least
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
