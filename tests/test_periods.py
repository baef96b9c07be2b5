"""Period bit words against sets of integers."""

import random

import pytest

from panelkit.operators import panel as PN
from panelkit.operators import periods as PE
from panelkit.plans.inspect import plan_facts


def _longest(years):
    best = run = 0
    last = None
    for y in sorted(years):
        run = run + 1 if last is not None and y == last + 1 else 1
        best, last = max(best, run), y
    return best


def _table(spark, sets, kind="INT"):
    rows = [(g, y, "v", 1.0) for g, ys in sets.items() for y in ys]
    return spark.createDataFrame(rows * 2, f"geo_id STRING, year {kind}, variable STRING, value DOUBLE")


def _sets(rng, lo, hi):
    out = {"full": list(range(lo, hi)), "one": [lo], "ends": [lo, hi - 1], "odd": list(range(lo, hi, 2))}
    for i in range(25):
        a = rng.randrange(lo, hi)
        block = list(range(a, min(hi, a + rng.randrange(1, 150))))
        out[f"r{i}"] = block + rng.sample(range(lo, hi), rng.randrange(1, 12))
    return out


# one word, several words as columns (negative periods too), and more words than columns
@pytest.mark.parametrize("lo, hi", [(1984, 2016), (2010, 2024), (-70, 130), (0, 512), (-300, 900)])
def test_words_hold_the_periods_and_their_longest_run(spark, lo, hi):
    sets = _sets(random.Random(hi), lo, hi)
    df = _table(spark, sets)
    years = {r.geo_id: r.years for r in PN.years_per_geo(df).collect()}
    assert years == {g: sorted(set(ys)) for g, ys in sets.items()}
    runs = {r.geo_id: r.longest_run for r in PN.longest_run(df).collect()}
    assert runs == {g: _longest(set(ys)) for g, ys in sets.items()}
    assert PE.period_span(df, "year").n_periods == len({y for ys in sets.values() for y in ys})


def test_far_periods_nulls_and_empty_tables(spark):
    far = {"a": [-2**62, 2**62, 2**62 + 1], "b": [5]}
    df = _table(spark, far, "BIGINT")
    assert {r.geo_id: r.longest_run for r in PN.longest_run(df).collect()} == {"a": 2, "b": 1}
    assert {r.geo_id: r.years for r in PN.years_per_geo(df).collect()} == far
    nulls = spark.createDataFrame([("a", None, "v", 1.0), (None, 2020, "v", 1.0), (None, 2021, "v", 1.0)],
                                  "geo_id STRING, year INT, variable STRING, value DOUBLE")
    assert [tuple(r) for r in PN.longest_run(nulls).collect()] == [(None, 2)]
    none = nulls.where("false")
    assert PN.longest_run(none).collect() == [] and PN.consecutive_year_filter(none).count() == 0
    with pytest.raises(TypeError):
        PN.longest_run(df.withColumn("year", df.year.cast("string")))


def test_one_exchange_and_no_window(spark):
    f = plan_facts(PN.longest_run(_table(spark, {"a": range(-70, 130), "b": [3]})))
    assert f["hash_exchanges"] == 1 and f["windows"] == 0 and f["sort_merge_joins"] == 0
