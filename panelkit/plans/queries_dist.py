"""Registered queries: distribution tables and sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelkit.operators import distributions as D
from panelkit.operators import sampling as SM
from panelkit.operators import standardize as ST
from panelkit.plans import sqlparts as Q
from panelkit.plans.queries import _round_all, query
from panelkit.schema import VALUE, VARIABLE
from panelkit.sources import tables as T


@query("histogram50", Q.histogram_sql(Q.SUPPLIER_PANEL, ["variable"], 50))
def q_histogram50(spark, sf):
    h = D.histogram(T.supplier_year_panel(spark, sf), (VARIABLE,), VALUE, 50)
    return _round_all(h, {"edge_lo", "edge_hi"})


_CLIPPED = f"""SELECT p.variable, greatest(q_low, least(q_high, value)) AS value
FROM ({Q.SUPPLIER_PANEL}) p JOIN (SELECT variable, quantile_cont(value, 0.01) AS q_low,
  quantile_cont(value, 0.99) AS q_high FROM ({Q.SUPPLIER_PANEL}) GROUP BY variable) q
  ON p.variable = q.variable WHERE value IS NOT NULL"""


@query("histogram_clipped30", Q.histogram_sql(_CLIPPED, ["variable"], 30))
def q_histogram_clipped30(spark, sf):
    clipped = ST.quantile_clip(T.supplier_year_panel(spark, sf))
    h = D.histogram(clipped.select(VARIABLE, F.col("clipped").alias(VALUE)), (VARIABLE,), VALUE, 30)
    return _round_all(h, {"edge_lo", "edge_hi"})


@query("histogram_by_year", Q.histogram_sql(Q.SUPPLIER_PANEL, ["variable", "year"], 20, ["variable"]))
def q_histogram_by_year(spark, sf):
    h = D.histogram_by_year(T.supplier_year_panel(spark, sf), 20)
    return _round_all(h, {"edge_lo", "edge_hi"})


_NORM = repr(1.0 / math.sqrt(2.0 * math.pi))
_KDE_SQL = f"""WITH d AS (SELECT variable, value FROM ({Q.SUPPLIER_PANEL}) WHERE value IS NOT NULL),
st AS (SELECT variable, count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
       FROM d GROUP BY variable),
s AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st WHERE n > 1 AND sd > 0 AND hi > lo),
g AS (SELECT s.*, d.value, CAST(j.range AS INTEGER) AS j
      FROM d JOIN s ON d.variable = s.variable CROSS JOIN range(0, 200) j)
SELECT variable, j, {Q.r6('min(lo + CAST(j AS DOUBLE) * (hi - lo) / 199.0)')} AS x,
  {Q.r6('sum(exp(-0.5 * pow((lo + CAST(j AS DOUBLE) * (hi - lo) / 199.0 - value) / h, 2)) * ' + _NORM + ') / (min(CAST(n AS DOUBLE)) * min(h))')} AS density
FROM g GROUP BY variable, j"""  # the direct kernel sum


@query("kde_curve", _KDE_SQL)
def q_kde_curve(spark, sf):
    k = D.kde_curve(T.supplier_year_panel(spark, sf), grid=200)
    return _round_all(k, {"x", "density"}).select(VARIABLE, "j", "x", "density")


_PAIR_FEATURES = list(T.SUPPLIER_FEATURES)


def _pairwise_sql(bins=10):
    parts = []
    rng = ", ".join(f"min({f}) AS {f}_lo0, max({f}) AS {f}_hi0" for f in _PAIR_FEATURES)
    fix = ", ".join(f"CASE WHEN {f}_lo0 = {f}_hi0 THEN {f}_lo0 - 0.5 ELSE {f}_lo0 END AS {f}_lo, "
                    f"CASE WHEN {f}_lo0 = {f}_hi0 THEN {f}_hi0 + 0.5 ELSE {f}_hi0 END AS {f}_hi"
                    for f in _PAIR_FEATURES)
    for i, a in enumerate(_PAIR_FEATURES):
        for b in _PAIR_FEATURES[i + 1:]:
            parts.append(
                f"SELECT year, '{a}' AS x_var, '{b}' AS y_var, "
                f"{Q.bin_sql(f'w.{a}', f'r.{a}_lo', f'r.{a}_hi', bins)} AS x_bin, "
                f"{Q.bin_sql(f'w.{b}', f'r.{b}_lo', f'r.{b}_hi', bins)} AS y_bin "
                f"FROM w CROSS JOIN r WHERE w.{a} IS NOT NULL AND w.{b} IS NOT NULL")
    return (f"WITH w AS ({Q.SUPPLIER_WIDE}), r0 AS (SELECT {rng} FROM w), r AS (SELECT {fix} FROM r0) "
            f"SELECT year, x_var, y_var, x_bin, y_bin, count(*) AS count FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY ALL")


@query("pairwise_bins", _pairwise_sql())
def q_pairwise_bins(spark, sf):
    return D.pairwise_bins(T.supplier_year_wide(spark, sf), _PAIR_FEATURES, bins=10)


@query("hash_sample", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE ((l_orderkey * 8 + l_linenumber) * 48271 + 42) % 2147483647 % 10000 < 500""")
def q_hash_sample(spark, sf):
    li = T.table(spark, sf, "lineitem").withColumn(
        "_k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return SM.hash_sample(li, "_k", 0.05, 42).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("hash_sample_text", """
SELECT geo_id, c_custkey FROM (SELECT '140US' || CAST(c_custkey AS VARCHAR) AS geo_id, c_custkey FROM customer)
WHERE CAST('0x' || substr(md5('42|' || geo_id), 1, 8) AS BIGINT) % 10000 < 500""")
def q_hash_sample_text(spark, sf):
    geo = T.table(spark, sf, "customer").select(
        F.concat(F.lit("140US"), F.col("c_custkey").cast("string")).alias("geo_id"), "c_custkey")
    return SM.hash_sample(geo, "geo_id", 0.05, 42)
