"""Summary statistics on the long panel: one aggregate each, no UDF.

All of them group by (variable) or (year, variable) and let Spark's hash
aggregate combine map-side.  Exact quartiles go through ``exact_quantiles``
(digit selection) instead of ``percentile``, whose final merge
holds every distinct value of a group in one task.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import join_on, materialise, stored
from panelkit.operators.quantiles import exact_quantiles
from panelkit.schema import PANEL, PanelColumns


def summary_stats(df: DataFrame, keys=None, value: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """count, mean, population std, min, max per group (nulls ignored)."""
    value = value or cols.value
    keys = list((cols.variable,) if keys is None else keys)
    v = F.col(value)
    return (df.where(v.isNotNull()).groupBy(*keys)
            .agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                 F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")))


def yearly_distribution(df: DataFrame, variable: str | None = None, value: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """mean, min, max per (variable, year), ordered by year."""
    value = value or cols.value
    data = df if variable is None else df.where(F.col(cols.variable) == variable)
    v = F.col(value)
    return (data.where(v.isNotNull()).groupBy(cols.variable, cols.year)
            .agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
            .orderBy(cols.variable, cols.year))


def geo_deltas(df: DataFrame, variable: str, value: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Change per geography: value at its last period minus value at its
    first (0.0 for a single period); equal periods order by value."""
    value = value or cols.value
    v = F.col(value)
    order = F.struct(F.col(cols.year), v)
    return (df.where((F.col(cols.variable) == variable) & v.isNotNull() & F.col(cols.year).isNotNull())
            .groupBy(cols.geo)
            .agg((F.max_by(v, order) - F.min_by(v, order)).alias("delta"),
                 F.count(v).alias("n_periods")))


def geo_delta_topn(df: DataFrame, variable: str, n: int = 10, value: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Top ``n`` geographies by |change| (ties by geo_id): a bounded
    TakeOrderedAndProject, never a full sort."""
    value = value or cols.value
    d = geo_deltas(df, variable, value, cols)
    return d.orderBy(F.abs("delta").desc(), F.col(cols.geo).asc()).limit(n)


def describe(df: DataFrame, keys=None, value: str | None = None, records: DataFrame | None = None,
             accuracy: int = 10_000, approximate: bool = False, cols: PanelColumns = PANEL) -> DataFrame:
    """pandas-style describe per group: count, mean, sample std, min,
    25/50/75 % (linear interpolation), max, missing, zeros, distinct.

    ``missing`` counts null values plus the records that lack the variable
    altogether; the number of records is the distinct (geo_id, year) pairs of
    ``records`` (default: the panel itself, within the other keys).
    ``approximate=True`` trades exactness for one pass: ``percentile_approx``
    quartiles (``accuracy``) and ``approx_count_distinct``.  The exact distinct
    count shuffles a group's distinct values (combined map-side), dealt by
    (group, value), so no group is one task.
    """
    df = stored(df)
    value = value or cols.value
    keys = list((cols.variable,) if keys is None else keys)
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("_nulls"),
        F.sum(F.when(v == 0, 1).otherwise(0)).alias("zeros"),
        (F.approx_count_distinct(v) if approximate else F.count_distinct(v)).alias("distinct"),
        *([F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_pq")] if approximate else []))
    if approximate:
        q = base.select(*keys, *[F.col("_pq")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])])
        base = base.drop("_pq")
    else:
        with ThreadPoolExecutor(1) as jobs:  # the aggregate and the selection are independent jobs
            first = jobs.submit(materialise, base)
            q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
            base = first.result()
    rec = records if records is not None else df
    other = [k for k in keys if k != cols.variable]
    if other:
        n_rec = rec.select(*other, cols.geo).distinct().groupBy(*other).agg(F.count(F.lit(1)).alias("_records"))
        out = join_on(join_on(base, q.drop("n") if "n" in q.columns else q, keys, "left"), n_rec, other, "left")
    else:
        n_rec_value = rec.select(cols.geo, cols.year).distinct().count()
        out = (join_on(base, q.drop("n") if "n" in q.columns else q, keys, "left")
               .withColumn("_records", F.lit(n_rec_value)))
    missing = F.col("_nulls") + (F.col("_records") - F.col("count") - F.col("_nulls"))
    return out.select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max",
                      missing.cast("long").alias("missing"), F.col("zeros").cast("long").alias("zeros"),
                      "distinct")


def describe_per_year(df: DataFrame, value: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """``describe`` per (year, variable)."""
    value = value or cols.value
    return describe(df, (cols.year, cols.variable), value, cols=cols)


def year_counts(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Records per period (distinct geographies per year)."""
    return df.groupBy(cols.year).agg(F.count_distinct(cols.geo).alias("n_geos"))


DESCRIBE_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max", "missing", "zeros", "distinct")


def describe_wide(per_year: DataFrame, years, cols: PanelColumns = PANEL) -> DataFrame:
    """The per-year description laid out as rows (variable, stat) and one
    column per year (the explicit ``years`` list avoids a distinct job)."""
    long = per_year.select(cols.year, cols.variable, *[F.col(c).cast("double").alias(c) for c in DESCRIBE_STATS])
    stacked = long.unpivot([cols.year, cols.variable], list(DESCRIBE_STATS), "stat", "v")
    return (stacked.groupBy(cols.variable, "stat").pivot(cols.year, [int(y) for y in years]).agg(F.first("v"))
            .orderBy(cols.variable, "stat"))
