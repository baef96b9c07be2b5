"""A training corpus from ``documents``: five stages, each working on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``; the last adds ``topic``, ``n_tokens``, ``expected_copies`` and ``n_copies`` (a column of the caller
with such a name goes on as ``input_<name>``).

Rows with null ids pass every stage that names documents by id; null texts fail the first quality rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import aside, broadcast_if_small, cut, stage, table
from panelkit.llm.decontam import contamination
from panelkit.llm.line_dedup import OUTPUTS, dedup_lines
from panelkit.llm.mixing import mix
from panelkit.llm.near_dedup import near_duplicates
from panelkit.llm.quality import keep_quality
from panelkit.llm.queries_model import mixing_sql
from panelkit.llm.queries_text import LINES_SQL, OP1_SQL, near_sql
from panelkit.llm.queries_web import OP10_SQL

NEAR_WORDS = 5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not among ``gone``."""
    gone = cut(gone.select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(broadcast_if_small(gone, gone.count()), F.col("doc_id") == F.col("__gone"), "left_anti")


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row of every id that repeats (the smallest in the order of its columns); null ids all stay."""
    again = cut(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__again")))
    n = again.count()
    if not n:
        return docs
    few = broadcast_if_small(again, n)
    one = docs.join(few, F.col("doc_id") == F.col("__again"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return docs.join(few, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(one.select("__row.*"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out of the texts."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    _, given = aside(docs, OUTPUTS)  # the caller's columns of these names
    return out.select(*[F.col(given.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group stays, in one row."""
    return _one_row_each(_without(docs, near_duplicates(docs, shingle=NEAR_WORDS).where("NOT kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go: exact windows of ten words only.  The proximity search is
    off here, so an item copied with a word changed in every ten passes."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark"), near=False).where("n_hit > 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at least once, with their number of copies."""
    return mix(docs).where("n_copies > 0")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def _over(sql: str, source: str) -> str:
    return sql.replace("documents", source)


ORACLE_SQL = f"""
WITH s1 AS MATERIALIZED (
  SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({OP1_SQL}) WHERE kept)),
s2 AS MATERIALIZED (
  SELECT s1.doc_id, l.kept AS text, lang, source, CASE WHEN n_removed > 0 THEN length(l.kept) ELSE n_chars END AS n_chars
  FROM s1 JOIN ({_over(LINES_SQL, "s1")}) l ON s1.doc_id = l.doc_id),
s3 AS MATERIALIZED (
  SELECT * FROM s2 WHERE doc_id IN (SELECT doc_id FROM ({_over(near_sql(NEAR_WORDS), "s2")}) WHERE kept)),
s4 AS MATERIALIZED (
  SELECT * FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM ({_over(OP10_SQL, "s3")}) WHERE contaminated))
SELECT s4.doc_id, s4.text, s4.lang, s4.source, s4.n_chars, m.topic, m.n_tokens, m.expected_copies, m.n_copies
FROM s4 JOIN ({_over(mixing_sql(), "s4")}) m ON s4.doc_id = m.doc_id WHERE m.n_copies > 0
"""
