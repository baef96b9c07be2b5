"""Registered queries: sequence packing, embedding whitening, hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import table
from panelkit.llm.hard_negatives import hard_negatives
from panelkit.llm.packing import pack
from panelkit.llm.whitening import whiten

REGISTRY: dict = {}


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector, with the exact deviation and the measured identity error
    (eigenvectors have no SQL form; tested against NumPy)."""
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*map(F.lit, model.explained.tolist())) if len(model.eigenvalues) else F.lit([]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


REGISTRY["op11_embedding_whitening"] = (op11_embedding_whitening, None)


def op12_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 2048 tokens (tokens have no SQL form; tested against
    the tokenizer library and by unpacking)."""
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


REGISTRY["op12_sequence_packing"] = (op12_sequence_packing, None)

OP13_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r ON a.id % 50 = 0 AND a.id <> r.id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id
  WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; a seventh of the labels is shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding"))


REGISTRY["op13_hard_negatives"] = (op13_hard_negatives, OP13_SQL)
