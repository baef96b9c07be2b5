"""Registered queries: PCA, KMeans, silhouette, DBSCAN, profiles.

PCA and KMeans results are not comparable across engines (start centres,
signs), so they are rows-only here and checked against NumPy in the tests;
the deterministic parts -- assignment to given centres, silhouette for given
labels, DBSCAN on coordinates, profiles -- have SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import dbscan as DB
from panelkit.operators import kmeans as KM
from panelkit.operators import profile as PR
from panelkit.operators import reduce as RD
from panelkit.operators import silhouette as SI
from panelkit.operators.sampling import hash_sample
from panelkit.plans import sqlparts as Q
from panelkit.plans.queries import _round_all, query
from panelkit.sources import tables as T

PCA_K = 6
KMEANS_K = 6
SEED = 42
DB_EPS, DB_MIN = 1.14, 3  # whole 64-D unit vectors
# Settings for the rows-only grid on the 6-D PCA scores (the distances of the
# unit-norm embeddings are far below the original grid's 2.0-3.0).
DB_GRID = ((0.15, 3), (0.18, 5), (0.20, 5), (0.25, 5))


def _pca(spark, sf):
    v = RD.array_matrix(T.vectors(spark, sf), "embedding", keep=("vec_id", "label"))
    return RD.pca_scores(v, PCA_K, keep=("vec_id", "label"))


@query("feature_matrix", f"""SELECT geo_id, year, [{", ".join(f"coalesce({f}, 0.0)" for f in T.SUPPLIER_FEATURES)}] AS features
FROM ({Q.SUPPLIER_WIDE})""")
def q_feature_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array
    m = RD.feature_matrix(T.supplier_year_wide(spark, sf), list(T.SUPPLIER_FEATURES))
    return m.select("geo_id", "year", vector_to_array("features").alias("features"))


@query("feature_columns", f"""SELECT geo_id, year, [{", ".join(f"coalesce({f}, 0.0)" for f in T.SUPPLIER_FEATURES)}] AS features
FROM ({Q.SUPPLIER_WIDE})""")
def q_feature_columns(spark, sf):
    """The matrix of all columns that are not static ones (no list given)."""
    from pyspark.ml.functions import vector_to_array
    m = RD.feature_matrix(T.supplier_year_wide(spark, sf))
    return m.select("geo_id", "year", vector_to_array("features").alias("features"))


@query("pca_scores", None)
def q_pca_scores(spark, sf):
    return _round_all(_pca(spark, sf).drop("pca"), {f"pc{i + 1}" for i in range(PCA_K)})


@query("kmeans_labels", None)
def q_kmeans_labels(spark, sf):
    return KM.kmeans_labels(_pca(spark, sf), KMEANS_K, SEED, "pca", keep=("vec_id",))


@query("kmeans_centroids", None)
def q_kmeans_centroids(spark, sf):
    return KM.centroid_table(KM.kmeans_fit(_pca(spark, sf), KMEANS_K, SEED, "pca"))


@query("elbow_curve", None)
def q_elbow_curve(spark, sf):
    return KM.elbow_curve(_pca(spark, sf), range(2, 11), SEED, "pca")


def _label_centroids(spark, sf):
    v = T.vectors(spark, sf)
    return (v.select("label", F.posexplode("embedding").alias("pos", "x"))
            .groupBy("label", "pos").agg(F.avg("x").alias("m"))
            .groupBy(F.col("label").alias("cluster"))
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
                 .alias("centre")))


_P = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


@query("assign_fixed_centroids", f"""
WITH p AS ({_P}),
u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS v FROM p),
c AS (SELECT label AS cluster, list(m ORDER BY i) AS centre FROM
      (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i) GROUP BY label),
dd AS (SELECT p.vec_id, c.cluster, list_sum(list_transform(list_zip(p.e, c.centre),
          lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p CROSS JOIN c),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS rn FROM dd)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, {Q.r6('d2')} AS dist2 FROM best WHERE rn = 1""")
def q_assign_fixed_centroids(spark, sf):
    out = KM.assign_fixed_centroids(T.vectors(spark, sf), _label_centroids(spark, sf), "embedding",
                                    keep=("vec_id",))
    return _round_all(out, {"dist2"})


def _lloyd_sql(k: int) -> str:
    """Centres from the first k vectors, moved until they stand still, as a one-row CTE ``fit``; points ``p``."""
    d2 = "list_transform(r.centres, lambda c: list_sum(list_transform(list_zip(p.e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    return f"""RECURSIVE p AS MATERIALIZED ({_P}),
r(round, centres, moved) AS (
  SELECT 0, (SELECT list(e ORDER BY vec_id) FROM (SELECT vec_id, e FROM p ORDER BY vec_id LIMIT {k})), 1.0::DOUBLE
  UNION ALL
  SELECT round + 1, now, list_max(list_transform(list_zip(flatten(was), flatten(now)), lambda z: abs(z[1] - z[2])))
  FROM (SELECT round, any_value(centres) AS was, list(coalesce(m, centres[s]) ORDER BY s) AS now FROM (
    SELECT r.round, r.centres, s.s, (SELECT list(v ORDER BY i) FROM (
        SELECT i, avg(v) AS v FROM (SELECT generate_subscripts(e, 1) AS i, unnest(e) AS v FROM (
          SELECT p.e, list_position(ds, list_min(ds)) AS c FROM (SELECT p.e, {d2} AS ds FROM p, r) p) WHERE c = s.s) GROUP BY i)) AS m
    FROM r, (SELECT unnest(range(1, {k + 1})) AS s) s WHERE r.moved > 1e-9) GROUP BY round)),
fit AS (SELECT centres FROM r ORDER BY round DESC LIMIT 1),
got AS (SELECT vec_id, list_position(ds, list_min(ds)) - 1 AS cluster, list_min(ds) AS dist2
        FROM (SELECT p.vec_id, {d2} AS ds FROM p, fit r))"""


def _first_vectors(spark, sf, k):
    rows = T.vectors(spark, sf).orderBy("vec_id").limit(k).collect()
    return [r["embedding"] for r in rows]


@query("cluster_kmeans", f"""WITH {_lloyd_sql(KMEANS_K)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, {Q.r6('dist2')} AS dist2 FROM got""")
def q_cluster_kmeans(spark, sf):
    """KMeans from given start centres to the end (the fits from random starts have no SQL form)."""
    out = KM.cluster_from(T.vectors(spark, sf), _first_vectors(spark, sf, KMEANS_K), "embedding", keep=("vec_id",))
    return _round_all(out, {"dist2"})


ELBOW_KS = range(2, 11)


@query("elbow_from_starts", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_lloyd_sql(k)} SELECT {k} AS k, {Q.r6('sum(dist2)')} AS inertia FROM got)" for k in ELBOW_KS))
def q_elbow_from_starts(spark, sf):
    out = KM.elbow_from(T.vectors(spark, sf), _first_vectors(spark, sf, max(ELBOW_KS)), ELBOW_KS, "embedding")
    return _round_all(out, {"inertia"})


_SIL = f"""WITH p AS ({_P}),
cnt AS (SELECT label, count(*) AS n FROM p GROUP BY label),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb,
        sum(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS sd
      FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT d.vec_id, max(CASE WHEN d.lb = d.la THEN d.sd / (c.n - 1) END) AS a,
         min(CASE WHEN d.lb <> d.la THEN d.sd / c.n END) AS b
       FROM d JOIN cnt c ON c.label = d.lb GROUP BY d.vec_id),
s AS (SELECT p.vec_id, p.label,
        CASE WHEN cn.n <= 1 OR ab.b IS NULL THEN 0.0 WHEN greatest(ab.a, ab.b) = 0 THEN 0.0
             ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END AS silhouette
      FROM p JOIN cnt cn ON cn.label = p.label LEFT JOIN ab ON ab.vec_id = p.vec_id)"""


@query("silhouette_score", f"{_SIL} SELECT {Q.r6('avg(silhouette)')} AS silhouette_score FROM s")
def q_silhouette_score(spark, sf):
    return _round_all(SI.silhouette_score(T.vectors(spark, sf), "embedding", "label"), {"silhouette_score"})


@query("silhouette_samples", f"""{_SIL}
SELECT vec_id, label, silhouette,
  CAST(row_number() OVER (PARTITION BY label ORDER BY silhouette, vec_id) - 1 AS BIGINT) AS rank
FROM (SELECT vec_id, label, {Q.r6('silhouette')} AS silhouette FROM s)""")
def q_silhouette_samples(spark, sf):
    s = _round_all(SI.silhouette_samples(T.vectors(spark, sf), "embedding", "label", keep=("vec_id",)),
                   {"silhouette"})
    return SI.silhouette_profile(s, "label", "silhouette", tie="vec_id").select(
        "vec_id", "label", "silhouette", "rank")


SAMPLE = 0.05
# the same sums over plain distances, for the hash sample of points against all points
_SIL_EUCLID = (_SIL.replace("sum(list_sum(", "sum(sqrt(list_sum(").replace("(z[1] - z[2]))))", "(z[1] - z[2])))))")
               .replace("FROM p a JOIN p b", "FROM sm a JOIN p b").replace("FROM p JOIN cnt cn", "FROM sm p JOIN cnt cn")
               .replace("d AS (SELECT a.vec_id", f"""sm AS (SELECT * FROM p WHERE ((vec_id % 2147483647) * 48271 + {SEED}) % 2147483647 % 10000 < {int(SAMPLE * 10000)}),
d AS (SELECT a.vec_id"""))


def _euclid(spark, sf):
    v = T.vectors(spark, sf)
    return SI.euclidean_silhouette(v, hash_sample(v, "vec_id", SAMPLE, SEED), "embedding", "label", "vec_id")


@query("silhouette_euclidean", f"{_SIL_EUCLID} SELECT vec_id, label, {Q.r6('silhouette')} AS silhouette FROM s")
def q_silhouette_euclidean(spark, sf):
    """The original's measure on its 5 % sample of points, each against the whole table."""
    return _round_all(_euclid(spark, sf), {"silhouette"})


@query("silhouette_euclidean_score", f"{_SIL_EUCLID} SELECT {Q.r6('avg(silhouette)')} AS silhouette_score FROM s")
def q_silhouette_euclidean_score(spark, sf):
    return _round_all(_euclid(spark, sf).agg(F.avg("silhouette").alias("silhouette_score")), {"silhouette_score"})


def _points(spark, sf):
    return T.vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))


def _pairs_sql(eps: float) -> str:
    return f"""p AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pr AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b,
         list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
       FROM p a JOIN p b ON a.id < b.id) WHERE d2 <= {eps * eps!r})"""


def _labels_sql(eps: float, least: int) -> str:
    return f"""WITH RECURSIVE {_pairs_sql(eps)},
deg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM pr UNION ALL SELECT b AS id FROM pr) GROUP BY id),
core AS (SELECT p.id FROM p LEFT JOIN deg ON deg.id = p.id WHERE coalesce(deg.d, 0) + 1 >= {least}),
ce AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
und AS (SELECT a, b FROM ce UNION ALL SELECT b AS a, a AS b FROM ce),
r(id, comp) AS (SELECT id, id FROM core UNION SELECT und.b, r.comp FROM r JOIN und ON r.id = und.a),
cc AS (SELECT id, min(comp) AS comp FROM r GROUP BY id),
num AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM cc)),
cl AS (SELECT cc.id, num.cluster FROM cc JOIN num ON num.comp = cc.comp),
bd AS (SELECT u.a AS id, min(cl.cluster) AS bc
       FROM (SELECT a, b FROM pr UNION ALL SELECT b AS a, a AS b FROM pr) u JOIN cl ON cl.id = u.b GROUP BY u.a)
SELECT p.id AS vec_id, CAST(CASE WHEN cl.cluster IS NOT NULL THEN cl.cluster ELSE coalesce(bd.bc, -1) END AS INTEGER)
  AS cluster, cl.cluster IS NOT NULL AS is_core
FROM p LEFT JOIN cl ON cl.id = p.id LEFT JOIN bd ON bd.id = p.id"""


@query("eps_neighbours", f"WITH {_pairs_sql(DB_EPS)} SELECT a, b, {Q.r6('d2')} AS d2 FROM pr")
def q_eps_neighbours(spark, sf):
    return _round_all(DB.eps_neighbours(_points(spark, sf), DB_EPS), {"d2"})


@query("dbscan_labels", _labels_sql(DB_EPS, DB_MIN))
def q_dbscan_labels(spark, sf):
    return DB.dbscan(_points(spark, sf), DB_EPS, DB_MIN).withColumnRenamed("id", "vec_id")


@query("dbscan_grid_pca", None)
def q_dbscan_grid_pca(spark, sf):
    """The grid on the PCA scores, as the original runs it (the scores have no SQL form)."""
    pts = _pca(spark, sf).select(F.col("vec_id").alias("id"),
                                 F.array(*[F.col(f"pc{i + 1}") for i in range(PCA_K)]).alias("x"))
    return DB.dbscan_grid(pts, DB_GRID)


# Settings on the raw vectors, where SQL can follow.
PROFILE_GRID = ((1.11, 3), (1.14, 3))
RAW_GRID = ((1.08, 3), (1.11, 3), (1.14, 3), (1.14, 8))


@query("dbscan_grid", " UNION ALL ".join(f"""
SELECT CAST({e!r} AS DOUBLE) AS eps, {m} AS min_samples, CAST(count(DISTINCT cluster) FILTER (cluster <> -1) AS INTEGER) AS n_clusters,
       CAST(count(*) FILTER (cluster = -1) AS INTEGER) AS n_noise FROM ({_labels_sql(e, m)})""" for e, m in RAW_GRID))
def q_dbscan_grid(spark, sf):
    return DB.dbscan_grid(_points(spark, sf), RAW_GRID)


@query("dbscan_grid_profile", " UNION ALL ".join(f"""
SELECT CAST({e!r} AS DOUBLE) AS eps, {m} AS min_samples, cluster, CAST(i - 1 AS INTEGER) AS dim, {Q.rnd('avg(v)', 2)} AS mean
FROM (SELECT l.cluster, generate_subscripts(x.embedding, 1) AS i, CAST(unnest(x.embedding) AS DOUBLE) AS v
      FROM ({_labels_sql(e, m)}) l JOIN embeddings x ON x.vec_id = l.vec_id WHERE l.cluster <> -1) GROUP BY cluster, i""" for e, m in PROFILE_GRID))
def q_dbscan_grid_profile(spark, sf):
    return DB.dbscan_grid_profile(_points(spark, sf), PROFILE_GRID)


_PROFILE_DIMS = 64  # the whole vector


@query("cluster_profile", f"""
SELECT cluster, {", ".join(f"{Q.rnd(f'avg(e{i})', 2)} AS e{i}" for i in range(_PROFILE_DIMS))}
FROM (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS cluster,
        {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(_PROFILE_DIMS))}
      FROM embeddings) WHERE cluster <> -1 GROUP BY cluster""")
def q_cluster_profile(spark, sf):
    v = T.vectors(spark, sf)
    wide = v.select(F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster"),
                    *[F.col("embedding")[i].alias(f"e{i}") for i in range(_PROFILE_DIMS)])
    return PR.cluster_profile(wide, "cluster", [f"e{i}" for i in range(_PROFILE_DIMS)])
