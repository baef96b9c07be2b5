"""Silhouette per point and overall, exact, in time linear in the data.

With squared Euclidean distance the mean distance of a point x to a cluster C
decomposes:  sum_{y in C} |x - y|^2 = n_C |x|^2 - 2 x . S_C + Q_C  with the
cluster's size n_C, vector sum S_C and sum of squared norms Q_C.  So one
aggregate per cluster (k rows) replaces the all-pairs distance matrix:
a(x) = own-cluster sum / (n_own - 1), b(x) = smallest other-cluster mean,
s = (b - a) / max(a, b), and 0 for a point alone in its cluster.  (This is
the measure of Spark's ``ClusteringEvaluator``.)

Plain Euclidean distance has no such decomposition, so ``euclidean_silhouette`` gives exact values for the points of a
sample, measured against *all* points: a block of sample points, bounded in bytes, goes to every task, which returns
one distance sum per (sample point, cluster).  No pair of points ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import bounded_collect, written
from panelkit.operators.ranking import with_global_index

MAX_K = 1000
BLOCK_BYTES = 16 << 20  # sample vectors sent to every task in one pass
CHUNK = 1 << 21  # distances a task holds at a time


def cluster_moments(df: DataFrame, features: str, cluster: str):
    """Per cluster: id, size, sum of squared norms, vector sum (k x d, bounded)."""
    x = F.col(features)
    norms = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)).alias("q"))
    sums = (df.select(cluster, F.posexplode(x).alias("pos", "v"))
            .groupBy(cluster, "pos").agg(F.sum("v").alias("s"))
            .groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("sv")))
    rows = bounded_collect(norms.join(sums, cluster), MAX_K, "clusters")
    rows = sorted(rows, key=lambda r: r[cluster])
    return [(r[cluster], int(r["n"]), float(r["q"]), [float(e["s"]) for e in r["sv"]]) for r in rows]


def silhouette_samples(df: DataFrame, features: str, cluster: str, keep=()) -> DataFrame:
    moments = cluster_moments(df, features, cluster)
    ids = F.array(*[F.lit(m[0]) for m in moments])
    ns = F.array(*[F.lit(float(m[1])) for m in moments])
    qs = F.array(*[F.lit(m[2]) for m in moments])
    ss = F.array(*[F.array(*[F.lit(v) for v in m[3]]) for m in moments])
    x = F.col(features)
    own = F.array_position(ids, F.col(cluster)).cast("int")
    k = len(moments)
    idx = F.sequence(F.lit(1), F.lit(k))
    sums = F.transform(idx, lambda i: F.element_at(ns, i) * F.col("_xx") - 2.0 * F.element_at(F.col("_dots"), i)
                       + F.element_at(qs, i))
    n_own = F.element_at(ns, own)
    a = F.element_at(F.col("_sums"), own) / (n_own - 1.0)
    b = F.array_min(F.transform(idx, lambda i: F.when(i != own, F.element_at(F.col("_sums"), i)
                                                      / F.element_at(ns, i))))
    s = (F.when((n_own <= 1.0) | b.isNull(), F.lit(0.0))
         .when(F.greatest(a, b) == 0, F.lit(0.0))
         .otherwise((b - a) / F.greatest(a, b)))
    return (df.select(*keep, cluster, x.alias("_x"))
            .withColumn("_xx", F.aggregate(F.col("_x"), F.lit(0.0), lambda acc, v: acc + v * v))
            .withColumn("_dots", F.transform(ss, lambda sv: F.aggregate(
                F.zip_with(F.col("_x"), sv, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)))
            .withColumn("_sums", sums)
            .select(*keep, cluster, s.alias("silhouette")))


def silhouette_score(df: DataFrame, features: str, cluster: str) -> DataFrame:
    return silhouette_samples(df, features, cluster).agg(F.avg("silhouette").alias("silhouette_score"))


def silhouette_profile(samples: DataFrame, cluster: str, order_col: str = "silhouette",
                       tie: str | None = None) -> DataFrame:
    """Rank of each point's value inside its cluster (the plot's order),
    without putting a whole cluster into one task."""
    order = [cluster, order_col] + ([tie] if tie else [])
    return with_global_index(samples, order, "rank", group_cols=[cluster])


def euclidean_silhouette(df: DataFrame, sample: DataFrame, features: str, cluster: str, id_col: str,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, cluster, silhouette`` of every row of ``sample`` (rows of ``df``, such as a ``hash_sample``) by plain
    Euclidean distance to all rows of ``df``.

    A block of sample vectors of at most ``block_bytes`` is broadcast and all points stream past it once, so a sample
    of several blocks takes as many passes; the driver never holds more than one block and the cluster sizes (at most
    ``MAX_K``).  A task keeps a sum per (block row, cluster) and a slab of distances, whatever its number of points.
    Rows with a null vector or cluster take no part; a point alone in its cluster and points of a single cluster get
    0; repeated rows count as points of their own."""
    spark = df.sparkSession
    x = F.col(features).cast("array<double>")
    known = F.col(features).isNotNull() & F.col(cluster).isNotNull()
    points = df.where(known).select(F.col(cluster).alias("c"), x.alias("x"))
    sizes = {r["c"]: r["n"] for r in bounded_collect(points.groupBy("c").agg(F.count(F.lit(1)).alias("n")), MAX_K, "clusters")}
    names = sorted(sizes)
    picked = written(with_global_index(sample.where(known).select(F.col(id_col).alias("id"), F.col(cluster).alias("c"), x.alias("x")),
                                       ["id"], "row"), "silhouette-sample")
    n, width = picked.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    rows = max(1, int(block_bytes) // (8 * max(1, width or 1)))
    code = F.array_position(F.lit(names) if names else F.array().cast("array<int>"), F.col("c")).cast("int") - 1
    coded = points.select(code.alias("c"), "x")
    kind = df.schema[cluster].dataType.simpleString()
    sums = [coded.mapInArrow(_block_sums(spark, picked, at, min(at + rows, n), len(names)), "row long, k int, s double")
            .groupBy("row", "k").agg(F.sum("s").alias("s")) for at in range(0, n, rows)]
    out_schema = [F.col("id").alias(id_col), F.col("c").cast(kind).alias(cluster)]
    if not sums:
        return picked.select(*out_schema, F.lit(0.0).alias("silhouette")).limit(0)
    # every block's sums are written on their own, so that its broadcast is not needed any more afterwards
    total = written(sums[0], "silhouette-sums")
    for part in sums[1:]:
        total = total.unionByName(written(part, "silhouette-sums"))
    size = F.element_at(F.lit([float(sizes[c]) for c in names]), F.col("k") + 1)
    own = F.col("k") == F.col("__own")
    ab = (total.join(picked.select("row", "id", "c", (code).alias("__own")), "row").groupBy("row", "id", "c")
          .agg(F.max(F.when(own, size)).alias("n"),
               F.max(F.when(own, F.when(size > 1, F.col("s") / (size - 1.0)))).alias("a"),
               F.min(F.when(~own, F.col("s") / size)).alias("b")))
    far = F.greatest("a", "b")
    s = F.when((F.col("n") <= 1) | F.col("b").isNull() | (far == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / far)
    return ab.select(*out_schema, s.alias("silhouette"))


def _block_sums(spark, picked: DataFrame, low: int, high: int, k: int):
    """Task function: distance sums of the sample rows ``low <= row < high`` to a task's points, by cluster."""
    block = picked.where((F.col("row") >= low) & (F.col("row") < high)).select("row", "x").orderBy("row").collect()
    shared = spark.sparkContext.broadcast((np.array([r["row"] for r in block], dtype=np.int64),
                                           np.array([r["x"] for r in block], dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ref = shared.value
        sums = np.zeros((len(rows), k))
        step = max(1, CHUNK // len(rows))
        seen = False
        for b in batches:
            if not b.num_rows:
                continue
            seen = True
            codes = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for at in range(0, len(x), step):
                # squares of differences, coordinate by coordinate: exact for equal points, no three-way array
                part, own = x[at:at + step], codes[at:at + step]
                d2 = np.zeros((len(rows), len(part)))
                for j in range(ref.shape[1]):
                    d2 += np.subtract.outer(ref[:, j], part[:, j]) ** 2
                dist = np.sqrt(d2)
                for c in np.unique(own):
                    sums[:, c] += dist[:, own == c].sum(axis=1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, k)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(rows))),
                                              pa.array(sums.ravel())], names=["row", "k", "s"])

    return run
