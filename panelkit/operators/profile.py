"""Cluster profile: mean of every numeric feature per cluster, noise dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.schema import STATIC_COLS, feature_columns


def round_half_up(c, digits: int):
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def cluster_profile(df: DataFrame, cluster: str = "cluster", features=None, digits: int = 2) -> DataFrame:
    features = list(features) if features is not None else feature_columns(df, STATIC_COLS + (cluster,))
    return (df.where(F.col(cluster) != -1).groupBy(cluster)
            .agg(*[round_half_up(F.avg(f), digits).alias(f) for f in features]))


def cluster_count(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters without noise, and noise points."""
    c = F.col(cluster)
    return labels.agg(F.count_distinct(F.when(c != -1, c)).alias("n_clusters"),
                      F.sum(F.when(c == -1, 1).otherwise(0)).cast("long").alias("n_noise"))
