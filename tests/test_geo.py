"""State / region tagging (FIXTURES §2) in both the map and the join form."""

import pytest

from panelkit.functions import geo

CASES = [
    ("1400000US06037101110", "California", "West"),
    ("1400000US72001956300", "Puerto Rico", "Unknown"),
    ("1400000US0603710111", "California", "Unknown"),
    ("8600000US46204", "South Dakota", "Unknown"),
    ("8600000US00601", "Unknown", "Unknown"),
    ("ZCTA5 46204", "ZCTA", "Unknown"),
    ("0500000US06037", "California", "Unknown"),
    ("0400000US06", "Unknown", "Unknown"),
    ("AB", "Unknown", "Unknown"),
]


@pytest.mark.parametrize("form", ["map", "join"])
def test_geo_table(spark, form):
    df = spark.createDataFrame([(g,) for g, _, _ in CASES], "geo_id STRING")
    tagged = geo.tag_geo(df) if form == "map" else geo.tag_geo_join(df)
    got = {r.geo_id: (r.state, r.region) for r in tagged.collect()}
    for g, s, r in CASES:
        assert got[g] == (s, r), g


def test_geo_tag_is_a_projection(spark):
    df = spark.createDataFrame([(g,) for g, _, _ in CASES], "geo_id STRING")
    plan = geo.tag_geo(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
