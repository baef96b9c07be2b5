"""Moments, winsorizing and z-scores per (period, variable) on the long panel.

``standardize_per_year`` is the flagship: for every (year, variable) group,
clip each value to the group's 5 % / 5 % winsor bounds (order statistics:
with k = floor(0.05 n) the k smallest become the (k+1)-th smallest and the k
largest the (n-k)-th), then score it against the mean and population standard
deviation of the *raw* values (0 when the deviation is 0).

Plan: the bounds and moments come from ``order_statistics`` (digit selection,
partial aggregates only); the scores are one broadcast join of the data to
that per-group table.  An input that is more than a plain scan is written once
and read by all passes; the data itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import join_on, small_side, stored
from panelkit.operators.quantiles import RankSpec, exact_quantiles, order_statistics
from panelkit.operators.ranking import with_global_index
from panelkit.schema import PANEL, PanelColumns


def year_feature_moments(df: DataFrame, keys=None, value: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """count, mean and population std per (year, variable)."""
    value = value or cols.value
    keys = list((cols.year, cols.variable) if keys is None else keys)
    return (df.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                 F.stddev_pop(value).alias("std")))


def winsor_specs(lower: float = 0.05, upper: float = 0.05) -> list[RankSpec]:
    return [RankSpec("low", lambda n: F.floor(F.lit(float(lower)) * n) + 1),
            RankSpec("high", lambda n: n - F.floor(F.lit(float(upper)) * n))]


def winsor_bounds(df: DataFrame, keys=None, value: str | None = None,
                  limits=(0.05, 0.05),
                  with_moments: bool = True, cols: PanelColumns = PANEL) -> DataFrame:
    """Per group: n, low, high (and mean, std of the raw values)."""
    value = value or cols.value
    keys = list((cols.year, cols.variable) if keys is None else keys)
    return order_statistics(df, keys, value, winsor_specs(*limits), with_moments)


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def winsorize(df: DataFrame, keys=None, value: str | None = None,
              limits=(0.05, 0.05), out: str = "raw_winsorized",
              cols: PanelColumns = PANEL) -> DataFrame:
    """Adds ``out`` = value clipped to its group's winsor bounds."""
    value = value or cols.value
    keys = list((cols.year, cols.variable) if keys is None else keys)
    df = stored(df)
    bounds = small_side(winsor_bounds(df, keys, value, limits, with_moments=False))
    return (join_on(df, bounds.select(*keys, "low", "high"), keys, "left")
            .withColumn(out, _clip(F.col(value), F.col("low"), F.col("high")))
            .drop("low", "high"))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise((x - mean) / std)


def standardize_per_year(df: DataFrame, keys=None, value: str | None = None,
                         limits=(0.05, 0.05), stats_on: str = "raw",
                         cols: PanelColumns = PANEL) -> DataFrame:
    """Long panel -> ``(geo_id, year, variable, raw_winsorized, z)``.

    ``stats_on='raw'`` (default) scores the winsorized value against the raw
    mean/std; ``'winsorized'`` uses moments of the winsorized values instead.
    Rows whose value is null carry no score and are dropped.
    """
    value = value or cols.value
    keys = list((cols.year, cols.variable) if keys is None else keys)
    data = stored(df.where(F.col(value).isNotNull()))
    bounds = small_side(winsor_bounds(data, keys, value, limits))
    scored = (join_on(data, bounds.select(*keys, "low", "high", "mean", "std"), keys)
              .withColumn("raw_winsorized", _clip(F.col(value), F.col("low"), F.col("high"))))
    if stats_on == "winsorized":
        wm = small_side(scored.groupBy(*keys).agg(F.avg("raw_winsorized").alias("_wm"),
                                                  F.stddev_pop("raw_winsorized").alias("_ws")))
        scored = join_on(scored, wm, keys).withColumn("mean", F.col("_wm")).withColumn("std", F.col("_ws"))
    out_cols = [c for c in df.columns if c not in (value,)]
    return scored.select(*out_cols, "raw_winsorized",
                         zscore(F.col("raw_winsorized"), F.col("mean"), F.col("std")).alias("z"))


def standardize_wide(scored: DataFrame, variables: list[str], geo_dim: DataFrame | None = None,
                     field: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Long scores -> one row per (geo_id, year) with a
    ``STRUCT<raw_winsorized, z>`` column per variable (or just the ``field``
    when given).  ``geo_dim`` (geo_id, year, static columns) is inner-joined:
    a record with no scored variable disappears, as in the original."""
    if field is None:
        cell = F.struct(F.col("raw_winsorized"), F.col("z"))
    else:
        cell = F.col(field)
    wide = (scored.groupBy(cols.geo, cols.year).pivot(cols.variable, list(variables))
            .agg(F.first(cell, ignorenulls=True)))
    if geo_dim is not None:
        wide = wide.join(geo_dim, [cols.geo, cols.year], "inner")
    return wide


def flatten_z(wide: DataFrame) -> DataFrame:
    """Struct cells ``{raw_winsorized, z}`` -> their ``z``; others unchanged."""
    cols = []
    for f in wide.schema.fields:
        names = getattr(f.dataType, "names", None)
        if names and "z" in names:
            cols.append(F.col(f.name).getField("z").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return wide.select(*cols)


def zscore_outliers(scored: DataFrame, variable: str, threshold: float = 3.0, cols: PanelColumns = PANEL) -> DataFrame:
    """Split of one variable's z-scores at ``threshold`` with a ``geo-year``
    label and the 0-based position in (geo_id, year) order (the plot's x)."""
    one = scored.where(F.col(cols.variable) == variable).select(cols.geo, cols.year, cols.variable, "z")
    indexed = with_global_index(one, [cols.geo, cols.year], "idx")
    return indexed.select(
        cols.geo, cols.year, cols.variable, "z", "idx",
        F.concat_ws("-", F.col(cols.geo), F.col(cols.year).cast("string")).alias("label"),
        (F.abs("z") > F.lit(float(threshold))).alias("is_outlier"))


def quantile_clip(df: DataFrame, keys=None, value: str | None = None,
                  lower: float = 0.01, upper: float = 0.99, out: str = "clipped",
                  cols: PanelColumns = PANEL) -> DataFrame:
    """Clip every value to its group's linear-interpolated lower/upper
    quantiles (pandas ``quantile`` + ``clip``); null values are dropped."""
    value = value or cols.value
    keys = list((cols.variable,) if keys is None else keys)
    data = stored(df.where(F.col(value).isNotNull()))
    q = small_side(exact_quantiles(data, keys, value, [lower, upper], ["q_low", "q_high"]))
    return (join_on(data, q.select(*keys, "q_low", "q_high"), keys)
            .withColumn(out, _clip(F.col(value), F.col("q_low"), F.col("q_high"))))
