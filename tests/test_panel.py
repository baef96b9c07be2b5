"""Run length, coverage, merge, pivot (FIXTURES §2 and properties)."""

from panelkit.operators import panel as PN
from panelkit.operators import standardize as ST
from panelkit.operators import stats as SS
from panelkit.schema import PanelColumns


def _long(spark, rows):
    return spark.createDataFrame(rows, "geo_id STRING, year INT, variable STRING, value DOUBLE")


def test_run_length_table(spark):
    sets = {"a": [2013, 2014, 2015], "b": [2013, 2015, 2016], "c": [2010, 2011, 2013, 2014, 2015],
            "d": [2020]}
    rows = [(g, y, "v", 1.0) for g, ys in sets.items() for y in ys]
    df = _long(spark, rows)
    keep3 = {r.geo_id for r in PN.consecutive_year_filter(df, 3).select("geo_id").distinct().collect()}
    assert keep3 == {"a", "c"}
    for n in (0, 1):
        assert PN.consecutive_year_filter(df, n).count() == len(rows)
    runs = {r.geo_id: r.longest_run for r in PN.longest_run(df).collect()}
    assert runs == {"a": 3, "b": 2, "c": 3, "d": 1}


def test_default_run_length_is_half_the_years(spark):
    one = _long(spark, [("a", 2020, "v", 1.0)])
    assert PN.default_run_length(one) == 0
    assert PN.consecutive_year_filter(one).count() == 1


def test_merge_last_wins_keeps_null_winner_and_is_layout_free(spark):
    rows = [("g", 2019, "v", 1.0, "p1", 3), ("g", 2019, "v", None, "p1", 5), ("g", 2019, "w", 2.0, "p0", 9),
            ("g", 2019, "w", 3.0, "p1", 1)]
    df = spark.createDataFrame(rows, "geo_id STRING, year INT, variable STRING, value DOUBLE, p STRING, pos INT")
    for frame in (df, df.repartition(3), df.repartition(1)):
        got = {r.variable: r.value for r in PN.merge_last_wins(frame, ["p", "pos"]).collect()}
        assert got == {"v": None, "w": 3.0}


def test_missing_years_and_feature_record(spark):
    df = _long(spark, [("a", 2011, "x", 1.0), ("a", 2013, "y", 2.0)])
    assert sorted(r.year for r in PN.missing_years(df, 2010, 2014).collect()) == [2010, 2012, 2014]
    rec = PN.feature_record(df, ["y", "x", "z"]).orderBy("year").collect()
    assert rec[0].asDict() == {"geo_id": "a", "year": 2011, "y": None, "x": 1.0, "z": None}


def test_ratio_feature_null_on_zero(spark):
    df = _long(spark, [("a", 1, "n", 6.0), ("a", 1, "d", 3.0), ("b", 1, "n", 1.0), ("b", 1, "d", 0.0)])
    got = {r.geo_id: r.value for r in PN.ratio_feature(df, ["n"], "d", "r").collect()}
    assert got == {"a": 2.0, "b": None}


def test_other_column_names(spark):
    """Every panel, statistics and standardize operator takes the table's own column names."""
    rows = [(f"g{i % 7}", 2010 + i % 4, f"v{i % 2}", float(i * i % 23)) for i in range(56)]
    own = _long(spark, rows)
    cols = PanelColumns("store", "week", "measure", "amount")
    other = own.toDF(*cols)
    calls = [
        (PN.years_per_geo, ()), (PN.longest_run, ()), (PN.consecutive_year_filter, ()), (PN.missing_years, (2008, 2015)),
        (PN.extract_features, (["v0"],)), (PN.feature_filter, (["v1"],)), (PN.feature_record, (["v0", "v1"],)),
        (PN.ratio_feature, (["v0"], "v1", "r")), (SS.summary_stats, ()), (SS.yearly_distribution, ()),
        (SS.geo_delta_topn, ("v0", 3)), (SS.describe_per_year, ()), (SS.year_counts, ()),
        (ST.year_feature_moments, ()), (ST.quantile_clip, ())]
    for fn, args in calls:
        a, b = fn(own, *args), fn(other, *args, cols=cols)
        swap = dict(zip(PanelColumns(), cols, strict=True))
        assert [swap.get(c, c) for c in a.columns] == b.columns, fn.__name__
        assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect()))), fn.__name__
    scored, scored2 = ST.standardize_per_year(own), ST.standardize_per_year(other, cols=cols)
    for fn, args in ((ST.standardize_wide, (["v0", "v1"],)), (ST.zscore_outliers, ("v0",))):
        a, b = fn(scored, *args).collect(), fn(scored2, *args, cols=cols).collect()
        assert sorted(map(repr, map(tuple, a))) == sorted(map(repr, map(tuple, b))), fn.__name__
