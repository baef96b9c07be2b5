"""Panel-shape operators on the long table ``(geo_id, year, variable, value)``; tables with other column
names pass them as ``cols`` (``PanelColumns``).

The periods of a geography are bit words combined in one partial aggregate (``operators/periods.py``), run
lengths come from shifts of those words, and the filter itself is a left-semi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.cells import is_valid_number
from panelkit.operators.common import small_side
from panelkit.operators.periods import Span, longest_run_of, period_span, period_words, periods_of
from panelkit.schema import EXPECTED_YEARS, PANEL, PanelColumns


def years_per_geo(df: DataFrame, cols: PanelColumns = PANEL, span: Span | None = None) -> DataFrame:
    """Sorted distinct periods of each geography."""
    kind = df.schema[cols.year].dataType.simpleString()
    return (period_words(df, [cols.geo], cols.year, span)
            .select(cols.geo, periods_of(F.col("words"), kind).alias("years")))


def longest_run(df: DataFrame, cols: PanelColumns = PANEL, span: Span | None = None) -> DataFrame:
    """Longest run of consecutive periods per geography."""
    return (period_words(df, [cols.geo], cols.year, span)
            .select(cols.geo, longest_run_of(F.col("words")).alias("longest_run")))


def default_run_length(df: DataFrame, cols: PanelColumns = PANEL) -> int:
    """Half the number of distinct periods, rounded down (0 for one period)."""
    return period_span(df, cols.year).n_periods // 2


def consecutive_year_filter(df: DataFrame, n: int | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Rows of the geographies having at least ``n`` consecutive periods (half of the table's periods by default)."""
    span = period_span(df, cols.year)
    if n is None:
        n = span.n_periods // 2
    keep = longest_run(df, cols, span).where(F.col("longest_run") >= n).select(cols.geo)
    # One row per geography: broadcast when its size is within the bound, so
    # the panel is filtered where it lies (a geography holding a large share
    # of the rows is never gathered into one task); above the bound the join
    # is a shuffle semi-join whose hot partitions AQE splits.
    return df.join(small_side(keep), cols.geo, "left_semi")


def missing_years(df: DataFrame, start: int = EXPECTED_YEARS[0], end: int = EXPECTED_YEARS[1], cols: PanelColumns = PANEL) -> DataFrame:
    """Expected periods ``start..end`` that no row has (left anti join)."""
    spark = df.sparkSession
    expected = spark.range(start, end + 1).select(F.col("id").cast("int").alias(cols.year))
    present = df.where(F.col(cols.year).isNotNull()).select(cols.year).distinct()
    return expected.join(present, cols.year, "left_anti")


def merge_last_wins(df: DataFrame, order_cols: list[str], cols: PanelColumns = PANEL) -> DataFrame:
    """One value per (geo_id, year, variable): the one of the last row in the
    order ``order_cols`` -- also when that value is null."""
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(cols.geo, cols.year, cols.variable)
            .agg(F.max_by(F.col(cols.value), order).alias(cols.value)))


def union_tables(*frames: DataFrame) -> DataFrame:
    """Union all by column name; columns missing on one side become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def extract_features(df: DataFrame, variables, cols: PanelColumns = PANEL) -> DataFrame:
    """Typed feature rows: requested variables with a period and a
    non-negative value, all features in one long frame."""
    return (df.where(F.col(cols.variable).isin(list(variables)) & F.col(cols.year).isNotNull()
                     & F.col(cols.value).isNotNull() & (F.col(cols.value) >= 0))
            .select(cols.geo, cols.year, cols.variable, cols.value))


def feature_filter(df: DataFrame, variables, cols: PanelColumns = PANEL) -> DataFrame:
    """Keep only the requested variables (applied before any widening)."""
    return df.where(F.col(cols.variable).isin(list(variables)))


def feature_record(df: DataFrame, variables, static: DataFrame | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Long -> one record per (geo_id, year) with one column per requested
    variable in the given order (null when absent).  The variable list is
    passed explicitly, so no extra job looks for distinct values."""
    wide = df.groupBy(cols.geo, cols.year).pivot(cols.variable, list(variables)).agg(F.first(cols.value))
    if static is not None:
        wide = wide.join(static, [cols.geo, cols.year], "left")
    return wide


def fill_zero(wide: DataFrame, features) -> DataFrame:
    return wide.fillna(0.0, subset=list(features))


def ratio_feature(df: DataFrame, numerators, denominator: str, name: str, cols: PanelColumns = PANEL) -> DataFrame:
    """New long rows ``name`` = sum(numerators) / denominator per (geo_id,
    year); null when the denominator is missing or zero."""
    v = F.col(cols.value)
    agg = (df.where(F.col(cols.variable).isin(list(numerators) + [denominator]))
           .groupBy(cols.geo, cols.year)
           .agg(F.sum(F.when(F.col(cols.variable).isin(list(numerators)), v)).alias("_num"),
                F.max(F.when(F.col(cols.variable) == denominator, v)).alias("_den")))
    ratio = F.when((F.col("_den").isNull()) | (F.col("_den") == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("_num") / F.col("_den"))
    return agg.select(cols.geo, cols.year, F.lit(name).alias(cols.variable), ratio.alias(cols.value))


def numeric_validity(df: DataFrame, text_col: str, keys=()) -> DataFrame:
    """Quality report of a text column: valid numbers, invalid and null cells."""
    t = F.col(text_col)
    valid = is_valid_number(t)
    return (df.groupBy(*keys)
            .agg(F.sum(F.when(valid, 1).otherwise(0)).cast("long").alias("n_valid"),
                 F.sum(F.when(t.isNotNull() & ~valid, 1).otherwise(0)).cast("long").alias("n_invalid"),
                 F.sum(F.when(t.isNull(), 1).otherwise(0)).cast("long").alias("n_null")))
