"""Cell normaliser, validity predicate and vintage from path (FIXTURES §2)."""

import pytest

from panelkit.functions import cells

CASES = [
    ("250,000+", 250000.0), ("2,500-", -2500.0), ("-666666666", -666666666.0), ("-5-", 5.0),
    ("5-+", 5.0), ("+5", 5.0), ("1e5", 100000.0), (" 7 ", 7.0), ("-", None), ("null", None),
    ("", None), ("**", None), ("(X)", None), ("+", None), ("--", None), ("1d", None), ("2F", None),
    ("0x10", None), ("1_000", None), ("nan", None), ("inf", None), ('"42"', 42.0), ("\u00a0 8\u00a0", 8.0),
    (None, None),
]


def test_normalise_cell_table(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i INT, c STRING")
    got = {r.i: r.v for r in df.select("i", cells.normalise_cell("c").alias("v")).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert got[i] == want, (raw, got[i], want)


def test_null_sentinels(spark):
    df = spark.createDataFrame([("-666666666",), ("5",)], "c STRING")
    got = [r.v for r in df.select(cells.normalise_cell("c", (-666666666,)).alias("v")).collect()]
    assert got == [None, 5.0]


@pytest.mark.parametrize("raw,valid", [
    (None, False), ("-", False), ("", False), ("null", False), ("N/A", False), (" N/A ", False),
    ("1,234", True), ("+5", True), ("5+", True), ("abc", False), ("1.5e3", True), ("(X)", False),
])
def test_is_valid_number(spark, raw, valid):
    df = spark.createDataFrame([(raw,)], "c STRING")
    assert df.select(cells.is_valid_number("c").alias("v")).first().v is valid


def test_year_from_path(spark):
    df = spark.createDataFrame([("/d/T1/2019/ACSDT5Y2019.B01-Data.csv",), ("/d/T3/empty-Data.csv",),
                                ("s3a://b/x/ACSDT5Y2010/ACSDT5Y2011.csv",)], "p STRING")
    got = [r.y for r in df.select(cells.year_from_path("p").alias("y")).collect()]
    assert got == [2019, None, 2010]
