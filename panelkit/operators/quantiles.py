"""Exact order statistics and quantiles per group by digit selection, without one task per group.

A (year, variable) group can hold a large share of all rows, so sorting each group inside one task does not
scale.  Instead the interval that holds each wanted rank is narrowed by a fixed number of histogram passes:

1. every value has a digit that never falls as the value rises.  In the first pass it is its sign and logarithm in
   ``DIGITS`` steps over all doubles; after that it is the place between the smallest and largest value of the
   interval, in ``DIGITS`` equal steps.  One aggregate per (group, interval, digit) counts rows and takes the
   smallest and largest value; only rows in a wanted interval of their group take part.
2. the counts of an interval's digits are added up in order (a window of at most ``DIGITS`` rows, never of data
   rows); the digit that reaches a wanted rank is its next interval, and the rows below it leave the rank.

A rank is done when the smallest and largest value of its interval agree.  A logarithmic step spans about 2**46.5
neighbouring doubles, so three passes of 2**16 equal steps come down to single values: four passes at most (more
with fewer steps), two for values of a few significant digits.  There is no sketch to miss and nothing to fall back to.  The
data is never shuffled as long as the table of groups is small enough to broadcast (checked).

An input that is more than a plain scan (an aggregate, a join ...) is written once and read by every pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.common import join_on, materialise, small_side, stored

DIGITS = 2**16


@dataclass(frozen=True)
class RankSpec:
    """A wanted order statistic: ``rank(n)`` is its 1-based rank in a group of ``n`` non-null values."""
    name: str
    rank: Callable[[Column], Column]


def log_digit(v: Column, digits: int) -> Column:
    """A whole number that never falls as ``v`` rises: sign and logarithm, NaN above all (as Spark orders it)."""
    a, top = F.abs(v), digits // 2
    step = F.floor((F.log2(a) + 1075.0) * (top / 2100)).cast("long") + 1  # 1 to ``top`` over all finite doubles
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(top + 1).cast("long")).otherwise(step)
    return F.when(F.isnan(v), F.lit(top + 2).cast("long")).otherwise(F.when(v < 0, -size).otherwise(size))


def _bins(rows: DataFrame, keys: list[str], digit: Column, more=()) -> DataFrame:
    """Rows, smallest and largest value per group, interval and digit."""
    return rows.groupBy(*keys, "_from", digit.alias("_digit")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *more)


def order_statistics(df: DataFrame, keys: list[str], value: str, specs: list[RankSpec],
                     moments: bool = False, digits: int = DIGITS) -> DataFrame:
    """One row per group: ``keys``, ``n``, one column per spec (the exact value at that rank, a double), and with
    ``moments`` also ``mean`` and the population deviation ``std``.  A null key is a key like any other."""
    keys = list(keys)
    base = stored(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    more = [F.avg("_v").alias("_avg"), F.var_pop("_v").alias("_var")] if moments else []
    bins = materialise(_bins(base.withColumn("_from", F.lit(0.0)), keys, log_digit(F.col("_v"), digits), more))
    stats = bins.groupBy(*keys).agg(F.sum("_c").alias("n"), *([(F.sum(F.col("_c") * F.col("_avg")) / F.sum("_c")).alias("mean")] if moments else []))
    if moments:  # the digits' moments are put together around the group's mean
        spread = F.col("_var") + (F.col("_avg") - F.col("mean")) * (F.col("_avg") - F.col("mean"))
        stats = join_on(bins, stats, keys).groupBy(*keys, "n", "mean").agg(F.sqrt(F.sum(F.col("_c") * spread) / F.first("n")).alias("std"))
    stats = small_side(stats)

    # the state: one row per group and wanted rank that is not done; ``_from`` names its interval
    state = stats.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(j).alias("_j"), s.rank(F.col("n")).cast("long").alias("_r")) for j, s in enumerate(specs)])).alias("_s"))
    state = state.select(*keys, "_s._j", "_s._r", F.lit(0.0).alias("_from"))
    done = None
    while True:
        w = Window.partitionBy(*keys, "_from").orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = join_on(bins.withColumn("_upto", F.sum("_c").over(w)), state, [*keys, "_from"])
        found = found.where((F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_c") < F.col("_r")))
        found = materialise(found.select(*keys, "_j", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"), "_lo", "_hi",
                                         F.col("_lo").eqNullSafe(F.col("_hi")).alias("_done")))
        ready = found.where("_done").select(*keys, "_j", "_lo")
        done = ready if done is None else done.unionByName(ready)
        left = found.where("NOT _done")
        if left.isEmpty():
            break
        state = left.select(*keys, "_j", "_r", F.col("_lo").alias("_from"))
        wanted = small_side(left.select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct())  # a few per group
        v, start, end = F.col("_v"), F.col("_from"), F.col("_to")
        rows = join_on(base, wanted, keys).where((v >= start) & (v <= end))
        bins = _bins(rows, keys, F.floor((v - start) / (end - start) * float(digits - 1)).cast("long"))
    values = done.groupBy(*keys).agg(*[F.max(F.when(F.col("_j") == j, F.col("_lo"))).alias(s.name) for j, s in enumerate(specs)])
    return join_on(stats, values, keys)


def linear_quantile_specs(probs) -> list[RankSpec]:
    """Two ranks per probability for linear interpolation (the pandas/NumPy
    default): h = (n-1)p, value = x[floor h] + frac * (x[floor h + 1] - x[floor h])."""
    specs = []
    for j, p in enumerate(probs):
        p = float(p)
        specs.append(RankSpec(f"_q{j}_a", lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1))
        specs.append(RankSpec(f"_q{j}_b", lambda n, p=p: F.least(F.floor((n - 1) * F.lit(p)) + 2, n)))
    return specs


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs, names,
                    digits: int = DIGITS) -> DataFrame:
    """Linear-interpolated quantiles per group, exact (same as
    ``percentile``/``quantile_cont``), one column per name."""
    stats = order_statistics(df, keys, value, linear_quantile_specs(probs), digits=digits)
    cols = []
    for j, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        a, b = F.col(f"_q{j}_a"), F.col(f"_q{j}_b")
        cols.append((a + frac * (b - a)).alias(name))
    drop = [c for c in stats.columns if c.startswith("_q")]
    return stats.select(*[c for c in stats.columns if c not in drop], *cols)
