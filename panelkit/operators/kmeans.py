"""KMeans on Spark ML, assignment to given centroids, and the elbow curve."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.common import bounded_collect, written
from panelkit.operators.sampling import hash_sample
from panelkit.operators.spatial import vectors

MAX_K = 1000
DIRECT_TASKS = 256


def kmeans_fit(df: DataFrame, k: int = 6, seed: int = 42, features: str = "pca", max_iter: int = 1000):
    """Returns the fitted model (centres, ``summary.trainingCost``).  Fits run until the centres stand still;
    one that still moves after ``max_iter`` rounds is reported by a warning."""
    km = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster", maxIter=max_iter)
    model = km.fit(df)
    if model.hasSummary and model.summary.numIter >= max_iter:
        warnings.warn(f"KMeans (k={k}) still moved after {max_iter} rounds", stacklevel=2)
    return model


def kmeans_labels(df: DataFrame, k: int = 6, seed: int = 42, features: str = "pca", keep=()) -> DataFrame:
    model = kmeans_fit(df, k, seed, features)
    return model.transform(df).select(*keep, F.col("cluster").cast("int").alias("cluster"))


def centroid_table(model) -> DataFrame:
    """The model's centres as rows ``(cluster, centre ARRAY<DOUBLE>)``."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster INT, centre ARRAY<DOUBLE>")


def squared_distance(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)


def assign_fixed_centroids(df: DataFrame, centroids: DataFrame, features: str, keep=(),
                           max_k: int = MAX_K) -> DataFrame:
    """Nearest of the given centroids (ties to the lowest cluster id) and the
    squared distance to it.  The centroid table (bounded by ``max_k``) is
    folded into the projection as a literal, so the points are not joined."""
    rows = sorted(bounded_collect(centroids, max_k, "centroids"), key=lambda r: r[0])
    return _nearest(df, [int(r[0]) for r in rows], [r[1] for r in rows], features, keep)


def _literal(centres) -> Column:
    # one literal however many centres and coordinates; it folds to a constant array
    return F.from_json(F.lit(json.dumps([[float(v) for v in c] for c in centres])), "array<array<double>>")


def _nearest(df: DataFrame, names: list, centres: list, features: str, keep=()) -> DataFrame:
    ids = F.lit(names)
    x = F.col(features)
    d2 = F.transform(_literal(centres), lambda c: squared_distance(x, c))
    best = F.array_min(d2)
    pos = F.array_position(d2, best)
    return df.select(*keep, F.element_at(ids, pos.cast("int")).alias("cluster"), best.alias("dist2"))


def _nearest_each(df: DataFrame, fits: dict, features: str, keep=()) -> DataFrame:
    """A row per point and fit of ``fits`` (name -> centres): ``fit, cluster, dist2``; the points are read once."""
    x = F.col(features)
    rows = F.array(*[_near_entry(name, F.transform(_literal(c), lambda v: squared_distance(x, v))) for name, c in fits.items()])
    return df.select(*keep, F.explode(rows).alias("__near")).select(*keep, "__near.*")


def _near_entry(name: int, d2: Column) -> Column:
    return F.aggregate(d2, F.struct(F.lit(name).alias("fit"), F.lit(0).alias("cluster"), F.lit(None).cast("double").alias("dist2"), F.lit(0).alias("at")),
                       lambda acc, d: F.struct(acc["fit"].alias("fit"),
                                               F.when(acc["dist2"].isNull() | (d < acc["dist2"]), acc["at"]).otherwise(acc["cluster"]).alias("cluster"),
                                               F.least(acc["dist2"], d).alias("dist2"), (acc["at"] + 1).alias("at")),
                       lambda acc: F.struct(acc["fit"].alias("fit"), acc["cluster"].alias("cluster"), acc["dist2"].alias("dist2")))


def _nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Row number of each row's nearest centre.  One matrix product decides; rows with two centres so close that its
    rounding could decide are summed term by term, in the order of the coordinates (ties to the lowest number)."""
    middle = centres.mean(axis=0)
    a, c = x - middle, centres - middle
    na, nc = (a * a).sum(axis=1), (c * c).sum(axis=1)
    d2 = nc - 2 * (a @ c.T)
    best = d2.argmin(axis=1)
    limit = d2[np.arange(len(x)), best] + 1e-12 * (na + nc.max()) * x.shape[1]
    doubt = np.flatnonzero((d2 <= limit[:, None]).sum(axis=1) > 1)
    for at in range(0, len(doubt), 1024):
        rows = doubt[at:at + 1024]
        total = np.zeros((len(rows), len(centres)))
        for j in range(x.shape[1]):
            total += np.subtract.outer(x[rows, j], centres[:, j]) ** 2
        best[rows] = total.argmin(axis=1)
    return best


def _partial_means(fits: dict):
    """Task function: mean and number of a task's points at every centre of every fit (a row each)."""
    names = list(fits)
    centres = [np.array(fits[n], dtype=np.float64) for n in names]
    start = np.concatenate([[0], np.cumsum([len(c) for c in centres])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((start[-1], centres[0].shape[1])), np.zeros(start[-1])
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors(b.column(0), centres[0].shape[1])
            own = np.zeros((len(x), start[-1]))
            for c, at in zip(centres, start, strict=False):
                own[np.arange(len(x)), at + _nearest_rows(x, c)] = 1.0
            sums += own.T @ x
            count += own.sum(axis=0)
        some = np.flatnonzero(count)
        fit = np.searchsorted(start, some, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, dtype=np.int64)[fit], pa.int32()), pa.array(some - start[fit], pa.int32()), pa.array(count[some]),
             pa.array(list(sums[some] / count[some, None]), pa.list_(pa.float64()))], names=["fit", "cluster", "n", "m"])

    return run


def _packed(points: DataFrame, d: int) -> DataFrame:
    """The vectors as little-endian doubles, dealt evenly and stored once for all rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten()
            if flat.null_count or (np.diff(lists.offsets.to_numpy()) != d).any():
                raise ValueError(f"a vector without {d} numbers")
            rows = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in rows], pa.binary())], names=["x"])

    tasks = points.sparkSession.sparkContext.defaultParallelism
    return written(points.mapInArrow(run, "x binary").repartition(tasks), "kmeans-points")


def kmeans_fits(df: DataFrame, fits: dict, features: str, tol: float = 1e-9, max_rounds: int = 1000, report: dict | None = None) -> dict:
    """Centres of several fits (name -> start centres) that advance together: points go to their nearest centre of
    every fit, centres to the mean of their points (one without points stays), until no coordinate of a fit moves by
    more than ``tol``; a fit that stands still leaves the rounds.  A round is one scan in which a task meets all
    centres by matrix products and returns a row a (fit, cluster), so there are as many scans as the longest fit has
    rounds (``report["scans"]``); only the centres reach the driver.  Null vectors are left out; an empty table
    returns the starts.  Fits still moving after ``max_rounds`` are reported by a warning."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    done = {int(n): [[float(v) for v in c] for c in starts] for n, starts in fits.items()}
    if max(map(len, done.values()), default=0) > MAX_K:
        raise ValueError(f"more than {MAX_K} centres")
    points = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))
    moving = {n: c for n, c in done.items() if c}
    if moving:
        points = _packed(points, len(next(iter(moving.values()))[0]))
    # a round returns a row a (task, fit, cluster); those of very many tasks are brought together on Spark
    few = bool(moving) and points.rdd.getNumPartitions() <= DIRECT_TASKS
    scans = 0
    while moving and scans < max_rounds:
        near = points.mapInArrow(_partial_means(moving), "fit int, cluster int, n double, m array<double>")
        if not few:
            near = (near.groupBy("fit", "cluster").agg(F.sum("n").alias("n"), Summarizer.mean(array_to_vector("m"), F.col("n")).alias("m"))
                    .withColumn("m", vector_to_array("m")))
        scans += 1
        parts: dict = {}
        for r in near.collect():
            parts.setdefault((r["fit"], r["cluster"]), []).append((r["n"], r["m"]))
        new = {n: list(c) for n, c in moving.items()}
        for (fit, cluster), got in parts.items():
            new[fit][cluster] = [float(v) for v in np.average([m for _, m in got], axis=0, weights=[n for n, _ in got])]
        shift = {n: max(abs(a - b) for p, q in zip(c, new[n], strict=True) for a, b in zip(p, q, strict=True)) for n, c in moving.items()}
        done.update(new)
        moving = {n: c for n, c in new.items() if shift[n] > tol}
    if moving:
        warnings.warn(f"centres still moved after {max_rounds} rounds", stacklevel=2)
    if report is not None:
        report["scans"] = scans
    return done


def kmeans_from(df: DataFrame, starts: list, features: str, tol: float = 1e-9, max_rounds: int = 1000) -> list:
    """Centres of one fit from the given start centres (see ``kmeans_fits``)."""
    return kmeans_fits(df, {0: starts}, features, tol, max_rounds)[0]


def cluster_from(df: DataFrame, starts: list, features: str, keep=()) -> DataFrame:
    """Cluster and squared distance of every point after ``kmeans_from``."""
    known = df.where(F.col(features).isNotNull())
    centres = kmeans_from(known, starts, features)
    return _nearest(known, list(range(len(centres))), centres, features, keep)


def elbow_from(df: DataFrame, starts: list, ks, features: str, report: dict | None = None) -> DataFrame:
    """``k, inertia`` of fits from the first k of the given start centres.  All k advance in the same scans, and one
    more scan sums the squared distances of every fit."""
    known = df.where(F.col(features).isNotNull())
    fits = kmeans_fits(known, {int(k): starts[:int(k)] for k in ks}, features, report=report)
    rows = {r["fit"]: float(r["inertia"] or 0.0)
            for r in _nearest_each(known, fits, features).groupBy("fit").agg(F.sum("dist2").alias("inertia")).collect()}
    return df.sparkSession.createDataFrame([(k, rows.get(k, 0.0)) for k in sorted(fits)], "k INT, inertia DOUBLE")


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("dist2").alias("inertia"))


def model_inertia(model, df: DataFrame, features: str = "pca") -> float:
    """Sum of squared distances to the final centres (Spark's
    ``summary.trainingCost`` is taken before the last centre update)."""
    from pyspark.ml.functions import vector_to_array
    cents = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    x = vector_to_array(F.col(features))
    own = F.element_at(cents, (F.col("cluster") + 1).cast("int"))
    return float(model.transform(df).agg(F.sum(squared_distance(x, own))).first()[0])


def elbow_curve(df: DataFrame, ks=range(2, 11), seed: int = 42, features: str = "pca",
                fraction: float = 1.0, key: str | None = None) -> DataFrame:
    """Within-cluster sum of squares for each k (one KMeans fit each).  With
    ``fraction`` < 1 the fits use a hash sample on ``key``."""
    data = df if fraction >= 1.0 else hash_sample(df, key, fraction, seed)
    data = data.select(features).cache()
    ks = [int(k) for k in ks]

    def fit(k):
        return k, model_inertia(kmeans_fit(data, k, seed, features), data, features)
    # The fits are independent Spark jobs: submit them concurrently and let the
    # scheduler share the executors instead of running them one after another.
    with ThreadPoolExecutor(max_workers=min(len(ks), 8)) as pool:
        rows = sorted(pool.map(fit, ks))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k INT, inertia DOUBLE")


def cluster_kmeans(df: DataFrame, features: str = "pca", k: int = 6, seed: int = 42, keep=()) -> dict:
    """Random starts: fit and return ``{"labels", "centroids", "inertia", "model"}``."""
    model = kmeans_fit(df, k, seed, features)
    labels = model.transform(df).select(*keep, F.col("cluster").cast("int").alias("cluster"))
    return {"labels": labels, "centroids": centroid_table(model),
            "inertia": model_inertia(model, df, features), "model": model}
