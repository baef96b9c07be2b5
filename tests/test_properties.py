"""Property tests: exact order statistics equal NumPy for any data and any
number of digits a pass; digits never fall as values rise."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from panelkit.operators import quantiles as QT
from panelkit.operators import standardize as ST

values = st.lists(st.one_of(st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=120)
groups = st.lists(values, min_size=1, max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=groups, digits=st.sampled_from([1000, 2**16]))
def test_order_statistics_property(spark, data, digits):
    rows = [(str(g), 2000, f"v{g}", float(x)) for g, xs in enumerate(data) for x in xs]
    df = spark.createDataFrame(rows, "geo_id STRING, year INT, variable STRING, value DOUBLE")
    got = {r.variable: r for r in ST.winsor_bounds(df).collect()}
    q = {r.variable: r for r in QT.exact_quantiles(df, ["year", "variable"], "value", [0.1, 0.5, 0.9],
                                                   ["a", "b", "c"], digits=digits).collect()}
    for g, xs in enumerate(data):
        a = np.sort(np.asarray(xs, float))
        n, k = len(a), int(0.05 * len(a))
        r = got[f"v{g}"]
        assert (r.low, r.high) == (a[k], a[n - k - 1])
        want = np.quantile(a, [0.1, 0.5, 0.9])
        assert (q[f"v{g}"].a, q[f"v{g}"].b, q[f"v{g}"].c) == pytest.approx(tuple(want), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("digits", [500, 2**16])
def test_digit_selection_stays_exact(spark, digits):
    rng = np.random.default_rng(11)
    data = [rng.normal(0, 1, 3000), rng.integers(0, 4, 2000).astype(float), np.full(500, 2.0),
            np.concatenate([rng.exponential(1, 2500), np.full(500, 7.0)])]
    rows = [(str(g), 2000, f"v{g}", float(x)) for g, xs in enumerate(data) for x in xs]
    df = spark.createDataFrame(rows, "geo_id STRING, year INT, variable STRING, value DOUBLE")
    got = {r.variable: r for r in QT.exact_quantiles(df, ["year", "variable"], "value", [0.05, 0.5, 0.95],
                                                     ["a", "b", "c"], digits=digits).collect()}
    for g, xs in enumerate(data):
        want = np.quantile(np.asarray(xs, float), [0.05, 0.5, 0.95])
        r = got[f"v{g}"]
        assert (r.a, r.b, r.c) == pytest.approx(tuple(want), rel=1e-12, abs=1e-12)


AWKWARD = [0.0, -0.0, 1.0, -1.0, 2.0, 1.9999999999999998, 2.0000000000000004, 5e-324, -5e-324, 2.2250738585072014e-308,
           2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1e-300, 1e300,
           0.1, 0.30000000000000004, 0.3, 1023.9999999999999, 1024.0, 8.98846567431158e307, 4503599627370497.5]


def test_digits_never_fall(spark):
    rng = np.random.default_rng(1)
    xs = AWKWARD + [float(2.0 ** e) for e in range(-1074, 1024)] + [float(np.nextafter(2.0 ** e, 0)) for e in range(-1070, 1024)]
    xs += [float(v) for v in rng.normal(0, 1, 300) * 10.0 ** rng.integers(-300, 300, 300)]
    df = spark.createDataFrame([(x,) for x in [*xs, float("nan")]], "v DOUBLE")
    got = [(r.v, r.d) for r in df.select("v", QT.log_digit(df.v, 2**16).alias("d")).collect()]
    ranked = sorted((v, d) for v, d in got if v == v)
    assert all(x[1] <= y[1] for x, y in zip(ranked, ranked[1:])) and len({d for _, d in ranked}) < 2**16 + 4
    assert next(d for v, d in got if v != v) > ranked[-1][1]


def test_order_statistics_of_awkward_values(spark):
    rows = [("g", x) for x in AWKWARD] + [("inf", x) for x in [float("inf")] * 3 + [float("-inf")] * 2] + [("nan", x) for x in [1.0, float("nan"), 2.0]]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    specs = [QT.RankSpec(f"r{i}", lambda n, i=i: F.lit(i)) for i in range(1, len(AWKWARD) + 1)]
    r = QT.order_statistics(df.where("k = 'g'"), ["k"], "v", specs).first()
    assert [r[f"r{i}"] for i in range(1, len(AWKWARD) + 1)] == sorted(AWKWARD)
    some = {r.k: (r.r1, r.r3) for r in QT.order_statistics(df.where("k <> 'g'"), ["k"], "v", specs[:3]).collect()}
    assert some["inf"] == (float("-inf"), float("inf")) and some["nan"][0] == 1.0 and np.isnan(some["nan"][1])


def _seq_dbscan(P, eps, ms):
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
            if core[j]:
                for k in nb[j]:
                    if lab[k] == -1:
                        lab[k] = c
                        stack.append(k)
        c += 1
    return lab


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), dims=st.sampled_from([2, 3]), ms=st.integers(2, 6),
       eps=st.sampled_from([0.05, 0.1, 0.3]), limit=st.sampled_from([4, 64]))
def test_cell_dbscan_equals_sequential(spark, seed, dims, ms, eps, limit):
    from panelkit.operators.dbscan_cells import dbscan_cells
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 1, (3, dims))
    pts = np.concatenate([c + rng.normal(0, 0.04, (60, dims)) for c in centres]
                         + [rng.uniform(0, 1, (40, dims)), np.repeat(centres[:1], 8, axis=0)])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id BIGINT, x ARRAY<DOUBLE>")
    got = {r.id: r.cluster for r in dbscan_cells(df, eps, ms, brute_limit=limit).collect()}
    assert [got[i] for i in range(len(pts))] == list(_seq_dbscan(pts, eps, ms))
