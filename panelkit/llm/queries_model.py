"""Registered queries: language identification, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import table
from panelkit.llm.language_id import fit, predict
from panelkit.llm.mixing import mix

REGISTRY: dict = {}


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document (accuracy on the held-out rows is tested)."""
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.where((rest != 2) & F.col("lang").isNotNull()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


REGISTRY["op2_language_id"] = (op2_language_id, None)


SQL_ROUNDS = 150  # mix() stops by tolerance; the rounds past it change nothing


def mixing_sql(rounds: int = SQL_ROUNDS) -> str:
    step = "r WHERE i < " + str(rounds)
    for m in ("source", "lang", "topic"):
        step = (f"(SELECT i, source, lang, topic, tokens, t_source, t_lang, t_topic,"
                f" w * t_{m} / sum(w) OVER (PARTITION BY {m}) AS w FROM {step})")
    power = {"source": "0.5", "lang": "0.5", "topic": "0.0"}
    shares = ",\n".join(f"p_{m} AS (SELECT {m}, p / sum(p) OVER () AS t_{m} FROM (SELECT {m}, pow(sum(tokens), {power[m]}) AS p FROM cells GROUP BY {m}))"
                        for m in power)
    return rf"""
WITH RECURSIVE ws AS (
  SELECT doc_id, source, lang, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x20\x09-\x0D]+') AS w FROM documents),
freq AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM ws) WHERE strlen(x) >= 5 GROUP BY doc_id, x),
top AS (SELECT doc_id, x FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(x)) AS k FROM freq) WHERE k = 1),
d AS (
  SELECT ws.doc_id, source, lang, len(w) AS n_tokens,
         CAST(coalesce(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 8, -1) AS INTEGER) AS topic
  FROM ws LEFT JOIN top ON ws.doc_id = top.doc_id),
all_cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
cells AS (SELECT * FROM all_cells WHERE tokens > 0),
{shares},
r AS (
  SELECT 0 AS i, cells.source, cells.lang, cells.topic, tokens, t_source, t_lang, t_topic, tokens AS w
  FROM cells JOIN p_source ON cells.source IS NOT DISTINCT FROM p_source.source
  JOIN p_lang ON cells.lang IS NOT DISTINCT FROM p_lang.lang JOIN p_topic ON cells.topic = p_topic.topic
  UNION ALL SELECT i + 1, source, lang, topic, tokens, t_source, t_lang, t_topic, w FROM {step}),
e AS (
  SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens,
         CASE WHEN d.n_tokens > 0 THEN floor(coalesce(w * (0.5::DOUBLE * (SELECT sum(tokens) FROM cells)) / tokens, 0) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE
              ELSE 0::DOUBLE END AS expected_copies
  FROM d LEFT JOIN r ON r.i = {rounds} AND d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic)
SELECT doc_id, source, lang, topic, n_tokens, expected_copies,
       CAST(floor(expected_copies) AS BIGINT) + CASE WHEN CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296::DOUBLE
         < expected_copies - floor(expected_copies) THEN 1 ELSE 0 END AS n_copies
FROM e
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of every document under raked source, language and topic shares."""
    return (mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
            .select("doc_id", "source", "lang", "topic", "n_tokens", "expected_copies", "n_copies"))


REGISTRY["op6_source_mixing"] = (op6_source_mixing, mixing_sql())
