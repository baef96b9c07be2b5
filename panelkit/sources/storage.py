"""Panel storage: JSON lines (key/value records), CSV summaries, Parquet.

JSON lines keep the record shape ``{"key": [geo_id, year], "value":
{variable: number}}``; reading uses an explicit schema (no inference pass)
and goes straight back to the long table.  Parquet is written partitioned by
year, so a year filter prunes whole folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.schema import GEO, VALUE, VARIABLE, YEAR

JSON_SCHEMA = "key ARRAY<STRING>, value MAP<STRING, DOUBLE>"

MAX_VARIABLES = 100_000  # columns of a wide record


def save_panel_json(panel: DataFrame, path: str) -> None:
    """One JSON line per (geo_id, year); replaces the target."""
    rec = (panel.groupBy(GEO, YEAR)
           .agg(F.map_from_entries(F.collect_list(F.struct(VARIABLE, VALUE))).alias("value")))
    (rec.select(F.array(F.col(GEO), F.col(YEAR).cast("string")).alias("key"), "value")
     .write.mode("overwrite").json(path))


def load_panel_json(spark: SparkSession, path: str) -> DataFrame:
    """Back to ``(geo_id, year, variable, value)``; null values survive."""
    raw = spark.read.schema(JSON_SCHEMA).json(path)
    return raw.select(F.col("key")[0].alias(GEO), F.col("key")[1].try_cast("int").alias(YEAR),
                      F.explode("value").alias(VARIABLE, VALUE))


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def save_panel_parquet(panel: DataFrame, path: str) -> None:
    # rows of a year and neighbouring geographies together: few files a year, hot years in several
    panel.repartitionByRange(YEAR, GEO).write.mode("overwrite").partitionBy(YEAR).parquet(path)


def load_panel_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(GEO, F.col(YEAR).cast("int").alias(YEAR), VARIABLE, VALUE)


def load_features(spark: SparkSession, path: str, variables=None, expected=(2010, 2023)):
    """Reload a saved panel and report its coverage: returns
    ``(records, years, missing)`` -- one wide record per (geo_id, year) with
    the requested variables (all when None), the distinct years present, and
    the expected years that are absent."""
    from panelkit.operators.common import bounded_collect
    from panelkit.operators.panel import feature_record, missing_years
    long = load_panel_json(spark, path)
    if variables is None:
        variables = sorted(r[0] for r in bounded_collect(long.where(F.col(VARIABLE).isNotNull()).select(VARIABLE).distinct(), MAX_VARIABLES, "variables"))
    records = feature_record(long, variables)
    years = long.where(F.col(YEAR).isNotNull()).select(YEAR).distinct()
    return records, years, missing_years(long, expected[0], expected[1])
