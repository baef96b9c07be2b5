"""Feature matrices and centred PCA with ``pyspark.ml``.

Spark's ``PCA`` finds the components of the covariance (centred) but
projects the *uncentred* rows, so rows are centred first with
``StandardScaler(withMean=True, withStd=False)``.  A component's sign is
arbitrary; it is fixed so that its largest-magnitude loading is positive,
which makes scores comparable across engines and runs.  Only the d x k
loading matrix reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.schema import STATIC_COLS, feature_columns


def feature_matrix(wide: DataFrame, features=None, out: str = "features",
                   keep=("geo_id", "year")) -> DataFrame:
    """Static columns dropped, missing features 0, one vector column."""
    features = list(features) if features is not None else feature_columns(wide, STATIC_COLS)
    filled = wide.fillna(0.0, subset=features)
    va = VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")
    return va.transform(filled).select(*[c for c in keep if c in wide.columns], out)


def array_matrix(df: DataFrame, array_col: str, out: str = "features", keep=()) -> DataFrame:
    """An ``ARRAY<DOUBLE>`` column as an ml vector."""
    return df.select(*keep, array_to_vector(F.col(array_col)).alias(out))


def fit_pca(df: DataFrame, k: int, features: str = "features"):
    """Returns (centring model, PCA model, signs)."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df)
    centred = scaler.transform(df)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pca").fit(centred)
    pc = pca.pc.toArray()
    signs = [1.0 if pc[int(np.argmax(np.abs(pc[:, j]))), j] >= 0 else -1.0 for j in range(pc.shape[1])]
    return scaler, pca, signs


def pca_scores(df: DataFrame, k: int = 6, features: str = "features", keep=(), out: str = "pca") -> DataFrame:
    """Centred PCA scores: ``keep`` columns, ``pc1..pck`` and a vector ``out``."""
    scaler, pca, signs = fit_pca(df, k, features)
    projected = pca.transform(scaler.transform(df))
    arr = vector_to_array(F.col("_pca"))
    sign_arr = F.array(*[F.lit(s) for s in signs])
    fixed = F.zip_with(arr, sign_arr, lambda a, s: a * s)
    out_df = projected.select(*keep, fixed.alias("_scores"))
    return out_df.select(*keep, *[F.col("_scores")[j].alias(f"pc{j + 1}") for j in range(k)],
                         array_to_vector(F.col("_scores")).alias(out))
