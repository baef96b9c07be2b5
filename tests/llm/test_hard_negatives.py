"""Hard negatives against brute force, scores against plain products, odd rows."""

import math

import numpy as np
import pytest

from panelkit.llm import hard_negatives as hn
from panelkit.llm.queries_vectors import OP13_SQL, op13_hard_negatives
from tests.conftest import SF_MID


@pytest.mark.parametrize("top,d", [(1, 3), (200, 64), (30_000, 17), (2**24, 9)])
def test_scores_are_inner_products(top, d):
    rng = np.random.default_rng(d)
    x = np.zeros((50, -(-d // 8) * 8), np.int64)
    x[:, :d] = rng.integers(-top, top + 1, (50, d))
    x[0, :d], x[1, :d] = -top, top
    planes = int(top).bit_length() + 1
    packed = hn.bit_planes(x, planes)
    assert (hn.from_planes(packed) == x).all()
    assert (hn.scores(hn.subset_sums(x[:20], planes), packed) == x @ x[:20].T).all()


def brute(rows, scale=256, every=50, low=50, high=95):
    """The contract, row by row."""
    use = sorted({(i, lab, tuple(math.floor(scale * c) for c in v)) for i, lab, v in rows
                  if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: B905, E731
    out = []
    for a in (r for r in use if r[0] % every == 0):
        ranked = sorted(((-dot(a[2], r[2]), r[0], r[1]) for r in use if r[0] != a[0]), key=lambda t: t[:2])
        for ps, pid, _ in [t for t in ranked if t[2] == a[1]][:5]:
            fit = [t for t in ranked if t[2] != a[1] and low * -ps <= 100 * -t[0] <= high * -ps][:3]
            out += [(a[0], pid, k + 1, t[1], -ps, -t[0]) for k, t in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, "a", "b") for i, lab, v in rows],
                                 "vec_id long, label int, embedding array<double>, q int, planes string, number string")


def mined(df, **how):
    return sorted(tuple(r) for r in hn.hard_negatives(df, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((3, 10))
    out = [(i, i % 3, (0.4 * centre[i % 3] + 0.5 * centre[0] + 0.3 * rng.standard_normal(10)).tolist()) for i in range(300)]
    return out + [(1000 + i, 1, out[7][2]) for i in range(60)] + [(2000 + i, 2, out[7][2]) for i in range(60)]  # a common vector


def test_against_brute_force(spark, rows):
    want = brute(rows, every=10)
    assert len(want) > 100
    assert mined(frame(spark, rows).repartition(5), every=10) == want
    assert mined(frame(spark, rows).coalesce(1), every=10, block_bytes=300) == want  # many blocks


def test_odd_rows(spark, rows):
    some = rows[:120] + [(None, 1, [1.0] * 10), (500, None, [1.0] * 10), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [math.nan] * 10),
                         (504, 1, [math.inf] * 10), (550, 1, [0.9, 0.8]), (551, 2, []), (50, 2, rows[3][2]), (7, 7 % 3, rows[7][2]), (-50, 0, [0.5] * 10)]
    want = brute(some)
    assert want and mined(frame(spark, some).repartition(3)) == want
    assert mined(frame(spark, some + some).repartition(4)) == want  # repeats count once
    assert mined(frame(spark, [])) == [] and mined(frame(spark, rows[1:3])) == [] and mined(frame(spark, rows[:1])) == []


def test_query_equals_its_sql(spark, duck):
    got = sorted(tuple(r) for r in op13_hard_negatives(spark, SF_MID).collect())
    assert got == sorted(duck.execute(OP13_SQL).fetchall()) and len(got) > 20
