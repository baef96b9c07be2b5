"""End-to-end run: ACS tree -> panel -> standardize -> PCA -> clusters.

``run_flow(spark, root, year=None, cluster='kmeans')`` returns a dict of
DataFrames (observations, geo_dim, filtered panel, scores, wide z table,
PCA scores, labels, cluster profile); nothing is collected except the
bounded model parameters inside the ML fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators import dbscan as DB
from panelkit.operators import kmeans as KM
from panelkit.operators import panel as PN
from panelkit.operators import profile as PR
from panelkit.operators import reduce as RD
from panelkit.operators import standardize as ST
from panelkit.operators.common import bounded_collect, materialise
from panelkit.schema import GEO, VARIABLE, YEAR
from panelkit.sources import acs


def run_flow(spark: SparkSession, root: str, year: int | None = None, cluster: str = "kmeans",
                 variables=None, file_glob: str = "*-Data.csv", k: int = 6, pca_k: int = 6,
                 eps: float = 2.0, min_samples: int = 3, run_length: int | None = None,
                 seed: int = 42) -> dict[str, DataFrame]:
    obs = materialise(acs.scan_acs(spark, root, variables, file_glob))  # read several times below
    dim = acs.geo_dim(spark, root, file_glob)
    panel = PN.consecutive_year_filter(obs, run_length)
    if year is not None:
        panel = panel.where(F.col(YEAR) == year)
    scores = ST.standardize_per_year(panel)
    scores = materialise(scores)
    names = variables or sorted(r[0] for r in bounded_collect(scores.select(VARIABLE).distinct(), 100_000, "variables"))
    wide = ST.standardize_wide(scores, names, dim, field="z")
    matrix = RD.feature_matrix(wide, names, keep=(GEO, YEAR))
    pcs = RD.pca_scores(matrix, min(pca_k, len(names)), keep=(GEO, YEAR))
    if cluster == "kmeans":
        labels = KM.kmeans_labels(pcs, k, seed, "pca", keep=(GEO, YEAR))
    elif cluster == "dbscan":
        n_pc = min(pca_k, len(names))
        pts = (pcs.withColumn("id", F.xxhash64(GEO, YEAR))
               .select("id", GEO, YEAR, F.array(*[F.col(f"pc{i + 1}") for i in range(n_pc)]).alias("x")))
        lab = DB.dbscan(pts.select("id", "x"), eps, min_samples)
        labels = pts.select("id", GEO, YEAR).join(lab, "id").select(GEO, YEAR, "cluster")
    else:
        raise ValueError(f"unknown cluster method {cluster!r}")
    profile = PR.cluster_profile(wide.join(labels, [GEO, YEAR]), "cluster", names)
    return {"observations": obs, "geo_dim": dim, "panel": panel, "scores": scores, "wide": wide,
            "pca": pcs, "labels": labels, "profile": profile}
