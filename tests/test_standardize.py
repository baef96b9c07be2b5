"""Exact order statistics, winsorize and z-score (FIXTURES §2, NumPy, properties)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import quantiles as QT
from panelkit.operators import standardize as ST


def _groups(spark, data):
    rows = [(g, 2020, "v", float(x)) for g, xs in data.items() for x in xs]
    return spark.createDataFrame(rows, "geo_id STRING, year INT, variable STRING, value DOUBLE") \
        .withColumn("geo_id", F.concat_ws("-", "geo_id", F.monotonically_increasing_id().cast("string")))


def _np_winsor(xs, lo=0.05, hi=0.05):
    a = np.sort(np.asarray(xs, float))
    n = len(a)
    k1, k2 = int(lo * n), int(hi * n)
    return a[k1], a[n - k2 - 1]


@pytest.mark.parametrize("n,low,high", [(19, 1, 19), (20, 2, 19), (40, 3, 38)])
def test_winsor_bounds_fixture(spark, n, low, high):
    df = spark.createDataFrame([(str(i), 2020, "v", float(i)) for i in range(1, n + 1)],
                               "geo_id STRING, year INT, variable STRING, value DOUBLE")
    b = ST.winsor_bounds(df).first()
    assert (b.low, b.high) == (low, high)


@pytest.mark.parametrize("digits", [2**16, 300])
def test_order_statistics_match_numpy_with_ties(spark, digits):
    rng = np.random.default_rng(7)
    data = {"a": rng.integers(0, 30, 3000), "b": rng.normal(0, 1, 2500), "c": np.full(50, 3.0),
            "d": np.concatenate([np.zeros(900), rng.normal(5, 1, 100)]), "e": [1.0]}
    df = _groups(spark, {k: list(v) for k, v in data.items()}).withColumn("year", F.lit(1))
    df = df.withColumn("variable", F.regexp_extract("geo_id", "^([a-e])", 1))
    got = {r.variable: (r.low, r.high) for r in ST.winsor_bounds(df).collect()}
    for k, xs in data.items():
        assert got[k] == pytest.approx(_np_winsor(xs)), k
    q = {r.variable: (r.p25, r.p50, r.p75) for r in
         QT.exact_quantiles(df, ["year", "variable"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"],
                            digits=digits).collect()}
    for k, xs in data.items():
        assert q[k] == pytest.approx(tuple(np.quantile(np.asarray(xs, float), [0.25, 0.5, 0.75]))), k


def test_standardize_properties(spark):
    rng = np.random.default_rng(3)
    xs = rng.lognormal(3, 1, 400)
    df = _groups(spark, {"g": list(xs), "const": [5.0] * 30})
    df = df.withColumn("variable", F.regexp_extract("geo_id", "^([a-z]+)", 1))
    out = ST.standardize_per_year(df)
    assert out.count() == 430
    const = out.where("variable = 'const'").select("z").distinct().collect()
    assert [r.z for r in const] == [0.0]
    g = np.array([r.raw_winsorized for r in out.where("variable = 'g'").collect()])
    lo, hi = _np_winsor(xs)
    assert g.min() == lo and g.max() == hi
    z = np.array([r.z for r in out.where("variable = 'g'").orderBy("geo_id").collect()])
    w = np.clip(np.array([r.value for r in df.where("variable = 'g'").orderBy("geo_id").collect()]), lo, hi)
    assert np.allclose(z, (w - xs.mean()) / xs.std())
    # Idempotent on its bounds: winsorizing the winsorized values keeps them.
    again = ST.winsorize(out.where("variable = 'g'").select("geo_id", "year", "variable",
                                                            F.col("raw_winsorized").alias("value")))
    assert again.where(F.col("raw_winsorized") != F.col("value")).count() == 0


def test_standardize_plan_does_not_shuffle_the_data(spark):
    from panelkit.sources import tables as T
    from tests.conftest import SF_SMALL
    out = ST.standardize_per_year(T.line_panel(spark, SF_SMALL))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # the scored rows reach the result through a broadcast join, not a sort-merge join
    assert "SortMergeJoin" not in plan


def test_describe_approximate_close_to_exact(spark):
    from panelkit.operators import stats as SS
    from panelkit.sources import tables as T
    from tests.conftest import SF_SMALL
    panel = T.supplier_year_panel(spark, SF_SMALL)
    exact = {r.variable: r for r in SS.describe(panel).collect()}
    approx = {r.variable: r for r in SS.describe(panel, approximate=True).collect()}
    for v, e in exact.items():
        a = approx[v]
        assert a["count"] == e["count"] and a["mean"] == pytest.approx(e["mean"])
        assert e["min"] <= a["p50"] <= e["max"]


def test_describe_wide_layout(spark):
    from panelkit.operators import stats as SS
    from panelkit.sources import tables as T
    from tests.conftest import SF_SMALL
    per_year = SS.describe_per_year(T.supplier_year_panel(spark, SF_SMALL))
    wide = SS.describe_wide(per_year, range(1995, 2002))
    assert wide.columns[:2] == ["variable", "stat"] and len(wide.columns) == 9
    assert wide.count() == 5 * len(SS.DESCRIBE_STATS)
    row = wide.where("variable = 'n_lines' AND stat = 'count'").first()
    assert row["1995"] == 10.0


def test_null_period_is_a_group(spark):
    rows = [("g%d" % i, None if i % 2 else 2020, "v", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "geo_id STRING, year INT, variable STRING, value DOUBLE")
    out = ST.standardize_per_year(df)
    assert out.count() == 60
    b = {r.year: (r.low, r.high) for r in ST.winsor_bounds(df).collect()}
    odd = sorted(float(i) for i in range(60) if i % 2)
    even = sorted(float(i) for i in range(60) if not i % 2)
    assert b[None] == _np_winsor(odd) and b[2020] == _np_winsor(even)
