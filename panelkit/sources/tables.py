"""Driver tables and the panels derived from them.

The driver's parquet tables have no ACS shape, so the panels below turn them
into ``observations(geo_id, year, variable, value)``: one geography key, one
integer period and a set of measures.  Each is a plain aggregate/projection,
so its SQL twin (``panelkit.plans.sqlparts``) reproduces it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.schema import FIPS_STATES, GEO, VALUE, VARIABLE, YEAR

SUPPLIER_FEATURES = ("avg_qty", "avg_price", "avg_disc", "avg_tax", "n_lines")
CUSTOMER_FEATURES = ("sum_price", "avg_price", "n_orders")
USER_FEATURES = ("sum_value", "n_events")
LINE_FEATURES = ("qty", "price", "disc", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def to_long(wide: DataFrame, keys: list[str], features) -> DataFrame:
    """Wide -> long; rows with a null value are kept (missing counts survive).
    NaN becomes null: Spark orders NaN above every number and ``NaN >= 0`` is
    true, so it would otherwise pass filters and poison sums."""
    long = wide.unpivot(keys, list(features), VARIABLE, VALUE)
    return long.withColumn(VALUE, F.when(F.isnan(VALUE), F.lit(None).cast("double")).otherwise(F.col(VALUE)))


def exact_mean(c, scale: int = 100):
    """Mean of a decimal-valued double column, computed on whole units of
    1/scale (exact integer sums) so that every engine and every summation
    order gives the same bits."""
    units = F.round(F.col(c) * F.lit(float(scale)))
    return F.sum(units) / F.count(F.lit(1)) / F.lit(float(scale))


def supplier_year_wide(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").cast("string").alias(GEO),
                       F.year("l_shipdate").alias(YEAR))
            .agg(exact_mean("l_quantity").alias("avg_qty"),
                 exact_mean("l_extendedprice").alias("avg_price"),
                 exact_mean("l_discount").alias("avg_disc"),
                 exact_mean("l_tax").alias("avg_tax"),
                 F.count(F.lit(1)).cast("double").alias("n_lines")))


def supplier_year_panel(spark, sf_dir) -> DataFrame:
    """Supplier x ship year, five measures, no gaps."""
    return to_long(supplier_year_wide(spark, sf_dir), [GEO, YEAR], SUPPLIER_FEATURES)


def customer_year_wide(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_custkey").cast("string").alias(GEO),
                      F.year("o_orderdate").alias(YEAR))
            .agg((F.sum(F.round(F.col("o_totalprice") * 100.0)) / 100.0).alias("sum_price"),
                 exact_mean("o_totalprice").alias("avg_price"),
                 F.count(F.lit(1)).cast("double").alias("n_orders")))


def customer_year_panel(spark, sf_dir) -> DataFrame:
    """Customer x order year; customers have gaps in their years."""
    return to_long(customer_year_wide(spark, sf_dir), [GEO, YEAR], CUSTOMER_FEATURES)


def user_day_panel(spark, sf_dir) -> DataFrame:
    """User x day (days since 1970 as the period), sum and count of events."""
    e = table(spark, sf_dir, "events")
    wide = (e.groupBy(F.col("user_id").cast("string").alias(GEO),
                      F.unix_date(F.to_date("ts")).alias(YEAR))
            .agg(F.sum("value").alias("sum_value"),
                 F.count(F.lit(1)).cast("double").alias("n_events")))
    return to_long(wide, [GEO, YEAR], USER_FEATURES)


def line_panel(spark, sf_dir) -> DataFrame:
    """One geography per line item (key orderkey-linenumber-partkey-suppkey,
    unique in the driver data), ship year, four raw measures: the large panel
    used for the standardize and describe benches."""
    li = table(spark, sf_dir, "lineitem")
    wide = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(GEO),
        F.year("l_shipdate").alias(YEAR),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    return to_long(wide, [GEO, YEAR], LINE_FEATURES)


FIPS_CODES = tuple(FIPS_STATES.keys())


def fips_pick(key_col) -> "F.Column":
    """A FIPS code chosen by key (deterministic spread over all 57 codes)."""
    codes = F.array(*[F.lit(c) for c in FIPS_CODES])
    return F.element_at(codes, (F.pmod(key_col, F.lit(len(FIPS_CODES))) + 1).cast("int"))


def geo_ids(spark, sf_dir) -> DataFrame:
    """Customer rows with a GEO_ID text in each of the forms the tagging rules
    distinguish (tract, short tract, ZIP, ZCTA, county, state), plus null and
    empty ids and null names for the key fallback."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    code = fips_pick(k)
    form = F.pmod(k, F.lit(6))
    text = (F.when(form == 0, F.concat(F.lit("1400000US"), code, F.lpad(k.cast("string"), 9, "0")))
            .when(form == 1, F.concat(F.lit("1400000US"), code, F.lpad(k.cast("string"), 8, "0")))
            .when(form == 2, F.concat(F.lit("8600000US"), F.lpad(F.pmod(k, F.lit(100000)).cast("string"), 5, "0")))
            .when(form == 3, F.concat(F.lit("ZCTA5 "), F.lpad(F.pmod(k, F.lit(100000)).cast("string"), 5, "0")))
            .when(form == 4, F.concat(F.lit("0500000US"), code, F.lpad(F.pmod(k, F.lit(1000)).cast("string"), 3, "0")))
            .otherwise(F.concat(F.lit("0400000US"), code)))
    raw_geo = (F.when(F.pmod(k, F.lit(11)) == 0, F.lit(None).cast("string"))
               .when(F.pmod(k, F.lit(17)) == 0, F.lit(""))
               .otherwise(text))
    raw_name = F.when(F.pmod(k, F.lit(22)) == 0, F.lit(None).cast("string")).otherwise(F.col("c_name"))
    return c.select(k.alias("c_custkey"), raw_geo.alias("GEO_ID"), raw_name.alias("NAME"))


def raw_cells(spark, sf_dir) -> DataFrame:
    """Line items with a text cell in the ACS notations: thousands commas,
    trailing ``+``/``-``, quotes, padding, exponents, null tokens, junk."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    ns = n.cast("string")
    form = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(10))
    text = (F.when(form == 0, F.format_number(n, 0))
            .when(form == 1, F.concat(ns, F.lit("+")))
            .when(form == 2, F.concat(F.format_number(n, 0), F.lit("-")))
            .when(form == 3, F.lit("null"))
            .when(form == 4, F.lit("(X)"))
            .when(form == 5, F.lit("-"))
            .when(form == 6, F.concat(F.lit('"'), ns, F.lit('"')))
            .when(form == 7, F.concat(F.col("l_linenumber").cast("string"), F.lit("e2")))
            .when(form == 8, F.concat(F.lit("  "), ns, F.lit(" ")))
            .otherwise(F.concat(F.lit("-"), ns, F.lit("-"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("cell"))


def vectors(spark, sf_dir) -> DataFrame:
    """Embedding vectors as DOUBLE arrays with their given label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
