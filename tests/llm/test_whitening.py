"""Embedding whitening against NumPy, its eigenvectors on awkward matrices, odd rows."""

import math

import numpy as np
import pytest

from panelkit.llm import whitening
from panelkit.llm.eigen import leading_eigenvectors
from panelkit.llm.queries_vectors import op11_embedding_whitening
from tests.conftest import SF_MID, SF_SMALL

RNG = np.random.default_rng(0)
Q = np.linalg.qr(RNG.standard_normal((40, 40)))[0]
B = RNG.standard_normal((90, 40))
MATRICES = {
    "one": np.array([[3.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "zero": np.zeros((9, 9)), "identity": np.eye(20),
    "random": B.T @ B, "tiny": B.T @ B * 1e-290, "ones": np.ones((30, 30)), "equal": np.diag([5.0, 5, 5, 3, 3, 1, 1, 0, 0]),
    "cluster": Q @ np.diag(np.r_[np.full(12, 7.0), np.linspace(1, 2, 28)]) @ Q.T, "steep": Q @ np.diag(10.0 ** -np.arange(40)) @ Q.T,
    "glued": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenvectors(name):
    a = MATRICES[name]
    values, vectors = leading_eigenvectors(a, 16)
    truth = np.linalg.eigvalsh(a)[::-1][:16]
    size = max(np.abs(truth).max(), np.finfo(float).tiny)
    assert np.abs(values - truth).max() <= 1e-12 * size and (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size


def exact(vectors):
    """x of the valid vectors and the fit list's numbers, with Python's whole numbers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    return x, fit, [sum(c) for c in zip(*fit, strict=True)]


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_against_numpy(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, fit, sums = exact([r["embedding"] for r in table])
    n = len(fit)
    rows = op11_embedding_whitening(spark, sf).collect()
    assert len(rows) == 16 * len(table) and {r["n"] for r in rows} == {n} and {r["component"] for r in rows} == set(range(1, 17))
    deviation = {r["vec_id"]: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for r, v in zip(table, x, strict=True)}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows)
    centred = np.array(fit) - np.array(sums) / n
    v = centred.T @ centred / n
    truth, axes = np.linalg.eigh(v)
    truth, axes = truth[::-1], axes[:, ::-1]
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    for k in range(16):
        mine = np.array([got[r["vec_id"], k + 1] for r in table])
        want = (np.array(x) - np.array(sums) / n) @ axes[:, k] / np.sqrt(truth[k])
        sign = np.sign(mine @ want)
        assert np.abs(mine * sign - want).max() < 1e-6
    assert all(abs(r["explained"] - truth[r["component"] - 1] / np.trace(v)) < 1e-10 for r in rows)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows],
                                 "vec_id long, embedding array<double>, x string, deviation string, whitened string")


def test_odd_rows(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 0.5]) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 0.0]), (102, [1.0, math.nan, 0.0]), (103, [math.inf, 0.0, 0.0]), (104, [1.0]), (105, [])]
    out, model = whitening.whiten(frame(spark, [*good, *bad, (None, good[3][1]), good[4]]).repartition(3))
    rows = out.collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in rows) == sorted([(True, 0), *((False, i) for i, _ in [*good, good[4]])])
    x, fit, _ = exact([v for _, v in good])
    assert model.n == len(fit) and len(model.eigenvalues) == 2  # the third entry never varies
    assert model.identity_error < 1e-12 and abs(model.explained.sum() - 1) < 1e-12
    assert next(r for r in rows if r["vec_id"] is None)["whitened"] == next(r for r in rows if r["vec_id"] == 3)["whitened"]


def test_copies_do_not_count(spark):
    some = [(i, [float(i), float(i * i % 11)]) for i in range(12)]
    a = whitening.whiten(frame(spark, some))[1]
    b = whitening.whiten(frame(spark, [*some, *[(50 + i, [3.0, 9.0]) for i in range(400)]]))[1]
    assert a.n == b.n == 12 and np.allclose(a.eigenvalues, b.eigenvalues, rtol=1e-12)


def test_one_vector_and_none(spark):
    out, model = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r["deviation"], r["whitened"]) for r in out.collect()] == [(0, []), (0, [])] and model.n == 1
    out, model = whitening.whiten(frame(spark, []))
    assert out.count() == 0 and model.n == 0


def test_huge_entries(spark):
    out, model = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]))
    rows = {r["vec_id"]: r for r in out.collect()}
    assert rows[1]["deviation"] is None and np.isfinite(rows[1]["whitened"]).all() and model.identity_error < 1e-6
