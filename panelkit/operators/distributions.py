"""Tables behind the distribution figures, computed in Spark.

Histograms bin like ``numpy.histogram``: ``bins`` equal-width bins over
[min, max] (widened by 0.5 each side when min == max), the last bin closed,
a value's bin checked against the edges ``lo + i * step`` so that values on an
edge land where NumPy puts them.  Empty bins are present with count 0.

The density curve is a Gaussian KDE with Scott's bandwidth (n^(-1/5) times
the sample standard deviation), evaluated on a grid from bins tied to the
bandwidth: the data is reduced to one row per filled bin first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import bounded_collect, join_on, small_side
from panelkit.schema import VALUE, VARIABLE, YEAR


def _bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """NumPy's bin index of x in ``bins`` equal bins over [lo, hi]."""
    width = hi - lo
    step = width / F.lit(float(bins))
    raw = F.floor((x - lo) * (F.lit(float(bins)) / width)).cast("int")
    raw = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))

    def edge(i):
        return F.when(i >= bins, hi).otherwise(i.cast("double") * step + lo)

    down = F.when(x < edge(raw), 1).otherwise(0)
    up = F.when((x >= edge(raw + 1)) & (raw != bins - 1), 1).otherwise(0)
    return F.least(F.greatest(raw - down + up, F.lit(0)), F.lit(bins - 1))


def _range_cols(lo: Column, hi: Column):
    same = lo == hi
    return (F.when(same, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(same, hi + 0.5).otherwise(hi).alias("hi"))


def histogram(df: DataFrame, keys=(VARIABLE,), value: str = VALUE, bins: int = 50,
              range_keys=None) -> DataFrame:
    """Counts per (keys, bin) with edges; ``range_keys`` (a prefix of keys)
    shares the [min, max] range across the other keys (e.g. per variable
    edges for a per-year histogram)."""
    keys = list(keys)
    range_keys = list(range_keys) if range_keys is not None else keys
    data = df.where(F.col(value).isNotNull())
    rng = data.groupBy(*range_keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rng = small_side(rng.select(*range_keys, *_range_cols(F.col("_lo"), F.col("_hi"))))
    binned = (join_on(data, rng, range_keys)
              .select(*keys, _bin_of(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    # Groups present, from the (small) per-bin counts: no extra pass over the data.
    groups = join_on(binned.select(*keys).distinct(), rng, range_keys)
    all_bins = groups.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (join_on(all_bins, binned, keys + ["bin"], "left")
            .select(*keys, "bin",
                    (F.col("bin").cast("double") * step + F.col("lo")).alias("edge_lo"),
                    F.when(F.col("bin") == bins - 1, F.col("hi"))
                    .otherwise((F.col("bin") + 1).cast("double") * step + F.col("lo")).alias("edge_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histogram_by_year(df: DataFrame, bins: int = 20, value: str = VALUE) -> DataFrame:
    """Per (variable, year) counts over edges shared by all years of a variable."""
    return histogram(df, (VARIABLE, YEAR), value, bins, range_keys=(VARIABLE,))


def kde_curve(df: DataFrame, keys=(VARIABLE,), value: str = VALUE, grid: int = 200,
              per_bandwidth: int = 512) -> DataFrame:
    """Gaussian KDE (Scott bandwidth ``h``) on ``grid`` points over [min, max] per group, from bins of width
    ``h / per_bandwidth`` that hold a value.  A bin stands at its mean, and its variance enters as the
    kernel's second-order term."""
    keys = list(keys)
    data = df.where(F.col(value).isNotNull())
    st = data.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"),
                                 F.min(value).alias("lo"), F.max(value).alias("hi"))
    st = small_side(st.where((F.col("n") > 1) & (F.col("sd") > 0) & (F.col("hi") > F.col("lo")))
                    .withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))))
    width = F.col("h") / F.lit(float(per_bandwidth))
    bins = (join_on(data, st.select(*keys, "lo", "h"), keys)
            .groupBy(*keys, F.floor((F.col(value) - F.col("lo")) / width).alias("b"))
            .agg(F.count(F.lit(1)).alias("c"), F.avg(value).alias("centre"), F.var_pop(value).alias("var")))
    gx = F.col("lo") + F.col("j").cast("double") * (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1))
    u = (gx - F.col("centre")) / F.col("h")
    norm = F.lit(1.0 / math.sqrt(2.0 * math.pi))
    second = F.lit(0.5) * (u * u - F.lit(1.0)) * F.col("var") / (F.col("h") * F.col("h"))
    contrib = F.col("c").cast("double") * F.exp(F.lit(-0.5) * u * u) * norm * (F.lit(1.0) + second)
    return (join_on(bins, st, keys)
            .select(*keys, "n", "h", "lo", "hi", "c", "centre", "var",
                    F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("j"))
            .groupBy(*keys, "j")
            .agg(F.first(gx).alias("x"),
                 (F.sum(contrib) / (F.first("n").cast("double") * F.first("h"))).alias("density")))


def pairwise_bins(wide: DataFrame, features, bins: int = 10, by=(YEAR,)) -> DataFrame:
    """2-D bin counts for every pair of ``features`` (per ``by``), each
    feature binned over its own overall [min, max]."""
    features = list(features)
    aggs = []
    for f in features:
        aggs += [F.min(f).alias(f"{f}__lo"), F.max(f).alias(f"{f}__hi")]
    row = bounded_collect(wide.agg(*aggs), 1, "feature ranges")[0]
    binned = {}
    for f in features:
        lo, hi = row[f"{f}__lo"], row[f"{f}__hi"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        binned[f] = _bin_of(F.col(f), F.lit(float(lo)), F.lit(float(hi)), bins)
    pairs = []
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            if a in binned and b in binned:
                pairs.append(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(),
                                    F.struct(F.lit(a).alias("x_var"), F.lit(b).alias("y_var"),
                                             binned[a].alias("x_bin"), binned[b].alias("y_bin"))))
    cells = wide.select(*by, F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("p"))
    return (cells.groupBy(*by, "p.x_var", "p.y_var", "p.x_bin", "p.y_bin")
            .agg(F.count(F.lit(1)).alias("count")))
