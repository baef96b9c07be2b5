"""Column names and fixed lookup values shared by all operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Long ("observations") layout used throughout the library.
GEO = "geo_id"
YEAR = "year"
VARIABLE = "variable"
VALUE = "value"


class PanelColumns(NamedTuple):
    """Names of a long panel's columns, for tables that call them otherwise."""

    geo: str = GEO
    year: str = YEAR
    variable: str = VARIABLE
    value: str = VALUE


PANEL = PanelColumns()

# Columns that describe a geography / period rather than a measure.  The union
# of every static list the original layouts use (forecasting names included).
STATIC_COLS = ("unique_id", "ds", "y", "year", "geo_id", "GEO_ID", "NAME", "name",
               "region", "state", "cluster", "label")

OBSERVATIONS_SCHEMA = T.StructType([
    T.StructField(GEO, T.StringType()),
    T.StructField(YEAR, T.IntegerType()),
    T.StructField(VARIABLE, T.StringType()),
    T.StructField(VALUE, T.DoubleType()),
])

# ---------------------------------------------------------------------------
# State FIPS codes and names, and the four statistical regions.
# They must equal the published lists for the tagging results to match.
# ---------------------------------------------------------------------------
FIPS_STATES = {
    "01": "Alabama", "02": "Alaska", "04": "Arizona", "05": "Arkansas",
    "06": "California", "08": "Colorado", "09": "Connecticut", "10": "Delaware",
    "11": "District of Columbia", "12": "Florida", "13": "Georgia", "15": "Hawaii",
    "16": "Idaho", "17": "Illinois", "18": "Indiana", "19": "Iowa", "20": "Kansas",
    "21": "Kentucky", "22": "Louisiana", "23": "Maine", "24": "Maryland",
    "25": "Massachusetts", "26": "Michigan", "27": "Minnesota", "28": "Mississippi",
    "29": "Missouri", "30": "Montana", "31": "Nebraska", "32": "Nevada",
    "33": "New Hampshire", "34": "New Jersey", "35": "New Mexico", "36": "New York",
    "37": "North Carolina", "38": "North Dakota", "39": "Ohio", "40": "Oklahoma",
    "41": "Oregon", "42": "Pennsylvania", "44": "Rhode Island",
    "45": "South Carolina", "46": "South Dakota", "47": "Tennessee", "48": "Texas",
    "49": "Utah", "50": "Vermont", "51": "Virginia", "53": "Washington",
    "54": "West Virginia", "55": "Wisconsin", "56": "Wyoming",
    "60": "American Samoa", "66": "Guam", "69": "Northern Mariana Islands",
    "72": "Puerto Rico", "74": "U.S. Minor Outlying Islands",
    "78": "U.S. Virgin Islands",
}

REGION_FIPS = {
    "Northeast": ("09", "23", "25", "33", "34", "36", "42", "44", "50"),
    "Midwest": ("17", "18", "19", "20", "26", "27", "29", "31", "38", "39", "46", "55"),
    "South": ("01", "05", "10", "11", "12", "13", "21", "22", "24", "28",
              "37", "40", "45", "47", "48", "51", "54"),
    "West": ("02", "04", "06", "08", "15", "16", "30", "32", "35", "41", "49", "53", "56"),
}

# Expected ACS 5-year vintages for the coverage report.
EXPECTED_YEARS = (2010, 2023)


def fips_table(spark: SparkSession) -> DataFrame:
    """57-row lookup ``(fips, state_name, region_name)``; region is null for
    codes in no region (territories)."""
    region_of = {code: region for region, codes in REGION_FIPS.items() for code in codes}
    rows = [(code, name, region_of.get(code)) for code, name in FIPS_STATES.items()]
    return spark.createDataFrame(
        rows, "fips STRING, state_name STRING, region_name STRING")


def feature_columns(df: DataFrame, exclude=STATIC_COLS) -> list[str]:
    """Numeric columns of a wide frame that are not static descriptors."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes
            if c not in exclude and (t in numeric or t.startswith("decimal"))]
