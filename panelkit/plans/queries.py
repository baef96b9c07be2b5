"""Registered queries: one per operator of the inventory.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql)``.
Every query reads the driver tables (or panels Spark derives from them) in
full.  Doubles are rounded to 6 places on both sides so that sums taken in a
different order still hash alike; every output column is aliased identically.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import cells, geo
from panelkit.operators import panel as PN
from panelkit.operators import standardize as ST
from panelkit.operators import stats as SS
from panelkit.plans import sqlparts as Q
from panelkit.schema import GEO, VALUE, VARIABLE, YEAR
from panelkit.sources import tables as T

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c) -> "F.Column":
    """floor(x * 1e6 + 0.5) / 1e6 in doubles: identical bits in Spark and in
    the SQL oracle (the engines' round() functions differ on ties)."""
    x = F.col(c) if isinstance(c, str) else c
    return (F.floor(x * F.lit(1000000.0) + F.lit(0.5)).cast("double") / F.lit(1000000.0))


def _round_all(df: DataFrame, names) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


# --------------------------------------------------------------------- E: standardize
@query("standardize_per_year", f"""
SELECT geo_id, year, variable, (floor((greatest(low, least(high, value))) * 1000000.0 + 0.5) / 1000000.0) AS raw_winsorized,
  (floor((CASE WHEN std = 0 THEN 0.0 ELSE (greatest(low, least(high, value)) - mean) / std END) * 1000000.0 + 0.5) / 1000000.0) AS z
FROM {Q.winsor_sql(Q.LINE_PANEL)}""")
def q_standardize_per_year(spark, sf):
    out = ST.standardize_per_year(T.line_panel(spark, sf))
    return _round_all(out, {"raw_winsorized", "z"})


@query("winsorize", f"""
SELECT geo_id, year, variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value,
  (floor((greatest(low, least(high, value))) * 1000000.0 + 0.5) / 1000000.0) AS raw_winsorized
FROM {Q.winsor_sql(Q.SUPPLIER_PANEL)}""")
def q_winsorize(spark, sf):
    out = ST.winsorize(T.supplier_year_panel(spark, sf).where(F.col(VALUE).isNotNull()))
    return _round_all(out.select(GEO, YEAR, VARIABLE, VALUE, "raw_winsorized"), {VALUE, "raw_winsorized"})


@query("zscore", f"""
SELECT geo_id, year, variable,
  (floor((CASE WHEN std = 0 THEN 0.0 ELSE (value - mean) / std END) * 1000000.0 + 0.5) / 1000000.0) AS z
FROM {Q.winsor_sql(Q.SUPPLIER_PANEL, lower=0.0, upper=0.0)}""")
def q_zscore(spark, sf):
    out = ST.standardize_per_year(T.supplier_year_panel(spark, sf), limits=(0.0, 0.0))
    return _round_all(out.select(GEO, YEAR, VARIABLE, "z"), {"z"})


_WIDE_Z_SQL = f"""
SELECT w.geo_id, w.year, avg_qty, avg_price, avg_disc, avg_tax, n_lines,
  {Q.state_sql('w.geo_id')} AS state, {Q.region_sql('w.geo_id')} AS region
FROM (SELECT geo_id, year,
   max(CASE WHEN variable = 'avg_qty' THEN z END) AS avg_qty,
   max(CASE WHEN variable = 'avg_price' THEN z END) AS avg_price,
   max(CASE WHEN variable = 'avg_disc' THEN z END) AS avg_disc,
   max(CASE WHEN variable = 'avg_tax' THEN z END) AS avg_tax,
   max(CASE WHEN variable = 'n_lines' THEN z END) AS n_lines
  FROM (SELECT geo_id, year, variable,
     (floor((CASE WHEN std = 0 THEN 0.0 ELSE (greatest(low, least(high, value)) - mean) / std END) * 1000000.0 + 0.5) / 1000000.0) AS z
     FROM {Q.winsor_sql(Q.SUPPLIER_PANEL)}) GROUP BY geo_id, year) w"""


def _supplier_geo_dim(spark, sf):
    wide = T.supplier_year_wide(spark, sf).select(GEO, YEAR)
    return geo.tag_geo(wide, GEO)


@query("standardize_wide", _WIDE_Z_SQL)
def q_standardize_wide(spark, sf):
    scored = _round_all(ST.standardize_per_year(T.supplier_year_panel(spark, sf)), {"z"})
    wide = ST.standardize_wide(scored, list(T.SUPPLIER_FEATURES), _supplier_geo_dim(spark, sf), field="z")
    return wide.select(GEO, YEAR, *T.SUPPLIER_FEATURES, "state", "region")


@query("flatten_z", _WIDE_Z_SQL)
def q_flatten_z(spark, sf):
    scored = _round_all(ST.standardize_per_year(T.supplier_year_panel(spark, sf)), {"z"})
    wide = ST.standardize_wide(scored, list(T.SUPPLIER_FEATURES), _supplier_geo_dim(spark, sf))
    return ST.flatten_z(wide).select(GEO, YEAR, *T.SUPPLIER_FEATURES, "state", "region")


@query("year_feature_moments", f"""
SELECT year, variable, count(value) AS n, (floor((avg(value)) * 1000000.0 + 0.5) / 1000000.0) AS mean, (floor((stddev_pop(value)) * 1000000.0 + 0.5) / 1000000.0) AS std
FROM ({Q.SUPPLIER_PANEL}) WHERE value IS NOT NULL GROUP BY year, variable""")
def q_year_feature_moments(spark, sf):
    return _round_all(ST.year_feature_moments(T.supplier_year_panel(spark, sf)), {"mean", "std"})


@query("zscore_outliers", f"""
SELECT geo_id, year, variable, z, CAST(row_number() OVER (ORDER BY geo_id, year) - 1 AS BIGINT) AS idx,
  geo_id || '-' || CAST(year AS VARCHAR) AS label, abs(z) > 2.0 AS is_outlier
FROM (SELECT geo_id, year, variable,
   (floor((CASE WHEN std = 0 THEN 0.0 ELSE (greatest(low, least(high, value)) - mean) / std END) * 1000000.0 + 0.5) / 1000000.0) AS z
   FROM {Q.winsor_sql(Q.CUSTOMER_PANEL)}) WHERE variable = 'sum_price'""")
def q_zscore_outliers(spark, sf):
    scored = _round_all(ST.standardize_per_year(T.customer_year_panel(spark, sf)), {"z"})
    return ST.zscore_outliers(scored, "sum_price", threshold=2.0)


@query("quantile_clip", f"""
SELECT geo_id, year, p.variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value,
  (floor((greatest(q_low, least(q_high, value))) * 1000000.0 + 0.5) / 1000000.0) AS clipped
FROM ({Q.SUPPLIER_PANEL}) p JOIN (SELECT variable, quantile_cont(value, 0.01) AS q_low,
  quantile_cont(value, 0.99) AS q_high FROM ({Q.SUPPLIER_PANEL}) GROUP BY variable) q
  ON p.variable = q.variable WHERE value IS NOT NULL""")
def q_quantile_clip(spark, sf):
    out = ST.quantile_clip(T.supplier_year_panel(spark, sf))
    return _round_all(out.select(GEO, YEAR, VARIABLE, VALUE, "clipped"), {VALUE, "clipped"})


# --------------------------------------------------------------------- D: aggregates
@query("summary_stats", f"""
SELECT variable, count(value) AS count, (floor((avg(value)) * 1000000.0 + 0.5) / 1000000.0) AS mean, (floor((stddev_pop(value)) * 1000000.0 + 0.5) / 1000000.0) AS std,
  (floor((min(value)) * 1000000.0 + 0.5) / 1000000.0) AS min, (floor((max(value)) * 1000000.0 + 0.5) / 1000000.0) AS max
FROM ({Q.SUPPLIER_PANEL}) WHERE value IS NOT NULL GROUP BY variable""")
def q_summary_stats(spark, sf):
    return _round_all(SS.summary_stats(T.supplier_year_panel(spark, sf)), {"mean", "std", "min", "max"})


@query("yearly_distribution", f"""
SELECT variable, year, (floor((avg(value)) * 1000000.0 + 0.5) / 1000000.0) AS mean, (floor((min(value)) * 1000000.0 + 0.5) / 1000000.0) AS min, (floor((max(value)) * 1000000.0 + 0.5) / 1000000.0) AS max
FROM ({Q.SUPPLIER_PANEL}) WHERE value IS NOT NULL GROUP BY variable, year ORDER BY variable, year""")
def q_yearly_distribution(spark, sf):
    return _round_all(SS.yearly_distribution(T.supplier_year_panel(spark, sf)), {"mean", "min", "max"})


@query("geo_delta_topn", f"""
SELECT geo_id, (floor((delta) * 1000000.0 + 0.5) / 1000000.0) AS delta, n_periods FROM (
  SELECT geo_id, max_by(value, year) - min_by(value, year) AS delta, count(value) AS n_periods
  FROM ({Q.CUSTOMER_PANEL}) WHERE variable = 'sum_price' AND value IS NOT NULL GROUP BY geo_id)
ORDER BY abs(delta) DESC, geo_id LIMIT 10""")
def q_geo_delta_topn(spark, sf):
    return _round_all(SS.geo_delta_topn(T.customer_year_panel(spark, sf), "sum_price", 10), {"delta"})


def _describe_sql(panel: str, keys: str, records: str) -> str:
    return f"""
SELECT {keys}, count(value) AS count, (floor((avg(value)) * 1000000.0 + 0.5) / 1000000.0) AS mean, (floor((stddev_samp(value)) * 1000000.0 + 0.5) / 1000000.0) AS std,
  (floor((min(value)) * 1000000.0 + 0.5) / 1000000.0) AS min, (floor((quantile_cont(value, 0.25)) * 1000000.0 + 0.5) / 1000000.0) AS p25,
  (floor((quantile_cont(value, 0.5)) * 1000000.0 + 0.5) / 1000000.0) AS p50, (floor((quantile_cont(value, 0.75)) * 1000000.0 + 0.5) / 1000000.0) AS p75,
  (floor((max(value)) * 1000000.0 + 0.5) / 1000000.0) AS max,
  CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) + ({records}) - count(value)
       - sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
  count(DISTINCT value) AS distinct
FROM ({panel}) p GROUP BY {keys}"""


_DESC_COLS = {"mean", "std", "min", "p25", "p50", "p75", "max"}


@query("describe_features", _describe_sql(
    f"{Q.CUSTOMER_PANEL} UNION ALL {Q.BALANCE_ROWS}", "variable",
    f"SELECT count(*) FROM (SELECT DISTINCT geo_id, year FROM ({Q.CUSTOMER_PANEL} UNION ALL {Q.BALANCE_ROWS}))"))
def q_describe_features(spark, sf):
    return _round_all(SS.describe(_customer_with_balance(spark, sf)), _DESC_COLS)


@query("describe_per_year", _describe_sql(
    Q.LINE_PANEL, "year, variable",
    f"SELECT count(DISTINCT geo_id) FROM ({Q.LINE_PANEL}) r WHERE r.year = p.year"))
def q_describe_per_year(spark, sf):
    return _round_all(SS.describe_per_year(T.line_panel(spark, sf)), _DESC_COLS)


_YEARS = range(1992, 1999)  # of lineitem's ship dates


@query("describe_wide", f"""
SELECT variable, stat, {", ".join(f'max(v) FILTER (year = {y}) AS "{y}"' for y in _YEARS)}
FROM (SELECT variable, year, unnest([{", ".join(f"'{s}'" for s in SS.DESCRIBE_STATS)}]) AS stat,
        unnest([{", ".join(f'CAST("{s}" AS DOUBLE)' for s in SS.DESCRIBE_STATS)}]) AS v
      FROM ({_describe_sql(Q.LINE_PANEL, "year, variable", f"SELECT count(DISTINCT geo_id) FROM ({Q.LINE_PANEL}) r WHERE r.year = p.year")}))
GROUP BY variable, stat""")
def q_describe_wide(spark, sf):
    per_year = _round_all(SS.describe_per_year(T.line_panel(spark, sf)), _DESC_COLS)
    return SS.describe_wide(per_year, _YEARS)


@query("year_counts", f"""
SELECT year, count(DISTINCT geo_id) AS n_geos FROM ({Q.CUSTOMER_PANEL}) GROUP BY year""")
def q_year_counts(spark, sf):
    return SS.year_counts(T.customer_year_panel(spark, sf))


@query("years_per_geo", f"""
SELECT geo_id, array_to_string(list_sort(list(DISTINCT year)), ',') AS years
FROM ({Q.CUSTOMER_PANEL}) GROUP BY geo_id""")
def q_years_per_geo(spark, sf):
    out = PN.years_per_geo(T.customer_year_panel(spark, sf))
    return out.select(GEO, F.concat_ws(",", F.col("years").cast("array<string>")).alias("years"))


_LONGEST_RUN_SQL = f"""(SELECT geo_id, CAST(max(len) AS INTEGER) AS longest_run FROM (
  SELECT geo_id, isl, count(*) AS len FROM (
    SELECT geo_id, year - row_number() OVER (PARTITION BY geo_id ORDER BY year) AS isl
    FROM (SELECT DISTINCT geo_id, year FROM ({Q.CUSTOMER_PANEL}) WHERE year IS NOT NULL))
  GROUP BY geo_id, isl) GROUP BY geo_id)"""


@query("longest_run", f"SELECT geo_id, longest_run FROM {_LONGEST_RUN_SQL}")
def q_longest_run(spark, sf):
    return PN.longest_run(T.customer_year_panel(spark, sf))


@query("consecutive_year_filter", f"""
SELECT geo_id, year, variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value FROM ({Q.CUSTOMER_PANEL}) p
WHERE geo_id IN (SELECT geo_id FROM {_LONGEST_RUN_SQL}
  WHERE longest_run >= (SELECT CAST(floor(count(DISTINCT year) / 2) AS INTEGER) FROM ({Q.CUSTOMER_PANEL})))""")
def q_consecutive_year_filter(spark, sf):
    return _round_all(PN.consecutive_year_filter(T.customer_year_panel(spark, sf)), {VALUE})


@query("missing_years", f"""
SELECT CAST(range AS INTEGER) AS year FROM range(1990, 2011)
WHERE range NOT IN (SELECT year FROM ({Q.CUSTOMER_PANEL}) WHERE year IS NOT NULL)""")
def q_missing_years(spark, sf):
    return PN.missing_years(T.customer_year_panel(spark, sf), 1990, 2010)


def _price_rows(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias(GEO), F.year("l_shipdate").alias(YEAR),
                     F.lit("price").alias(VARIABLE),
                     F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_extendedprice"))
                     .cast("double").alias(VALUE),
                     "l_orderkey", "l_linenumber", "l_partkey")


@query("merge_last_wins", """
SELECT geo_id, year, variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS geo_id, CAST(year(l_shipdate) AS INTEGER) AS year, 'price' AS variable,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS value,
    row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate)
                       ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_merge_last_wins(spark, sf):
    out = PN.merge_last_wins(_price_rows(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey"])
    return _round_all(out, {VALUE})


def _balance_rows(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias(GEO),
                    (F.lit(1995) + F.col("c_nationkey") % 7).cast("int").alias(YEAR),
                    F.lit("acctbal").alias(VARIABLE), F.col("c_acctbal").alias(VALUE))


def _customer_with_balance(spark, sf):
    return PN.union_tables(T.customer_year_panel(spark, sf), _balance_rows(spark, sf))


@query("union_tables", f"""
SELECT geo_id, year, variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value, src FROM (
  SELECT *, 'orders' AS src FROM ({Q.CUSTOMER_PANEL})
  UNION ALL SELECT *, NULL AS src FROM ({Q.BALANCE_ROWS}))""")
def q_union_tables(spark, sf):
    a = T.customer_year_panel(spark, sf).withColumn("src", F.lit("orders"))
    return _round_all(PN.union_tables(a, _balance_rows(spark, sf)), {VALUE})


@query("extract_features", f"""
SELECT geo_id, year, variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value FROM ({Q.CUSTOMER_PANEL} UNION ALL {Q.BALANCE_ROWS})
WHERE variable IN ('sum_price', 'acctbal') AND year IS NOT NULL AND value IS NOT NULL AND value >= 0""")
def q_extract_features(spark, sf):
    return _round_all(PN.extract_features(_customer_with_balance(spark, sf), ["sum_price", "acctbal"]), {VALUE})


@query("feature_filter", f"""
SELECT geo_id, year, variable, (floor((value) * 1000000.0 + 0.5) / 1000000.0) AS value FROM ({Q.SUPPLIER_PANEL})
WHERE variable IN ('avg_qty', 'n_lines')""")
def q_feature_filter(spark, sf):
    return _round_all(PN.feature_filter(T.supplier_year_panel(spark, sf), ["avg_qty", "n_lines"]), {VALUE})


@query("feature_record", f"""
SELECT geo_id, year, (floor((max(CASE WHEN variable = 'n_orders' THEN value END)) * 1000000.0 + 0.5) / 1000000.0) AS n_orders,
  (floor((max(CASE WHEN variable = 'acctbal' THEN value END)) * 1000000.0 + 0.5) / 1000000.0) AS acctbal,
  CAST(NULL AS DOUBLE) AS absent_var
FROM ({Q.CUSTOMER_PANEL} UNION ALL {Q.BALANCE_ROWS}) GROUP BY geo_id, year""")
def q_feature_record(spark, sf):
    wide = PN.feature_record(_customer_with_balance(spark, sf), ["n_orders", "acctbal", "absent_var"])
    return _round_all(wide.withColumn("absent_var", F.col("absent_var").cast("double")),
                      {"n_orders", "acctbal", "absent_var"})


@query("fill_zero", f"""
SELECT geo_id, year, (floor((coalesce(max(CASE WHEN variable = 'n_orders' THEN value END), 0.0)) * 1000000.0 + 0.5) / 1000000.0) AS n_orders,
  (floor((coalesce(max(CASE WHEN variable = 'acctbal' THEN value END), 0.0)) * 1000000.0 + 0.5) / 1000000.0) AS acctbal
FROM ({Q.CUSTOMER_PANEL} UNION ALL {Q.BALANCE_ROWS}) GROUP BY geo_id, year""")
def q_fill_zero(spark, sf):
    wide = PN.feature_record(_customer_with_balance(spark, sf), ["n_orders", "acctbal"])
    return _round_all(PN.fill_zero(wide, ["n_orders", "acctbal"]), {"n_orders", "acctbal"})


@query("ratio_feature", f"""
SELECT geo_id, year, 'avg_check' AS variable,
  (floor((CASE WHEN den IS NULL OR den = 0 THEN NULL ELSE num / den END) * 1000000.0 + 0.5) / 1000000.0) AS value
FROM (SELECT geo_id, year, sum(CASE WHEN variable = 'sum_price' THEN value END) AS num,
        max(CASE WHEN variable = 'n_orders' THEN value END) AS den
      FROM ({Q.CUSTOMER_PANEL}) WHERE variable IN ('sum_price', 'n_orders') GROUP BY geo_id, year)""")
def q_ratio_feature(spark, sf):
    return _round_all(PN.ratio_feature(T.customer_year_panel(spark, sf), ["sum_price"], "n_orders",
                                       "avg_check"), {VALUE})


# --------------------------------------------------------------------- B: cells, geography
@query("cell_normalise", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, {Q.normalise_sql('cell')} AS value
FROM ({Q.RAW_CELLS})""")
def q_cell_normalise(spark, sf):
    raw = T.raw_cells(spark, sf)
    return raw.withColumn("value", cells.normalise_cell("cell"))


@query("numeric_validity", f"""
SELECT l_linenumber, CAST(sum(CASE WHEN {Q.valid_sql('cell')} THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
  CAST(sum(CASE WHEN cell IS NOT NULL AND NOT ({Q.valid_sql('cell')}) THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid,
  CAST(sum(CASE WHEN cell IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null
FROM ({Q.RAW_CELLS}) GROUP BY l_linenumber""")
def q_numeric_validity(spark, sf):
    return PN.numeric_validity(T.raw_cells(spark, sf), "cell", ["l_linenumber"])


_GEO_KEY = f"coalesce({Q.clean_text_sql('\"GEO_ID\"')}, {Q.clean_text_sql('\"NAME\"')})"


@query("geo_key", f"""
SELECT c_custkey, geo_key FROM (SELECT c_custkey, {_GEO_KEY} AS geo_key FROM ({Q.GEO_IDS}))
WHERE geo_key IS NOT NULL""")
def q_geo_key(spark, sf):
    g = T.geo_ids(spark, sf)
    key = F.coalesce(cells.clean_text("GEO_ID"), cells.clean_text("NAME"))
    return g.select("c_custkey", key.alias("geo_key")).where(F.col("geo_key").isNotNull())


@query("geo_state", f"""
SELECT c_custkey, geo_key, {Q.state_sql('geo_key')} AS state
FROM (SELECT c_custkey, {_GEO_KEY} AS geo_key FROM ({Q.GEO_IDS})) WHERE geo_key IS NOT NULL""")
def q_geo_state(spark, sf):
    k = q_geo_key(spark, sf)
    return k.withColumn("state", geo.state_of("geo_key"))


@query("geo_region", f"""
SELECT c_custkey, geo_key, {Q.state_sql('geo_key')} AS state, {Q.region_sql('geo_key')} AS region
FROM (SELECT c_custkey, {_GEO_KEY} AS geo_key FROM ({Q.GEO_IDS})) WHERE geo_key IS NOT NULL""")
def q_geo_region(spark, sf):
    k = q_geo_key(spark, sf)
    return geo.tag_geo_join(k, "geo_key")
