"""Registered queries: URL filter, benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import table
from panelkit.llm.decontam import contamination
from panelkit.llm.url_filter import filter_urls

REGISTRY: dict = {}


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url; the fitted weights have no SQL form (rules and held-out accuracy are tested)."""
    return filter_urls(table(spark, sf_dir, "pages"))


REGISTRY["op7_url_filter"] = (op7_url_filter, None)

OP10_SQL = r"""
WITH RECURSIVE tx AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM tx),
wins AS (
  SELECT id, least(10, len(ws)) AS k, list_slice(ws, i, i + least(10, len(ws)) - 1) AS g
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM w WHERE kind = 'b' AND len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
spots AS (
  SELECT id, k, i, list_slice(ws, i, i + k - 1) AS g
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE kind = 'd' AND len(ws) >= k)),
m AS (SELECT DISTINCT s.id, s.i, s.k, wins.id AS item FROM spots s JOIN wins ON s.k = wins.k AND s.g = wins.g),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS p FROM m) GROUP BY id),
its AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM m) GROUP BY id),
bt AS (SELECT DISTINCT id, unnest(ws) AS term FROM w WHERE kind = 'b'),
post AS (
  SELECT id, pos, term FROM (SELECT id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM w WHERE kind = 'd')
  WHERE term IN (SELECT term FROM bt)),
cf AS (SELECT term, count(*) AS cf FROM post GROUP BY term),
rare AS (
  SELECT id, term FROM (
    SELECT bt.id, bt.term, row_number() OVER (PARTITION BY bt.id ORDER BY cf, bt.term) AS k,
           count(*) OVER (PARTITION BY bt.id) AS n
    FROM bt JOIN cf ON bt.term = cf.term) WHERE k <= 5 AND n >= 5),
near AS (SELECT rare.id AS item, post.id, post.pos, post.term FROM rare JOIN post ON rare.term = post.term),
close AS (
  SELECT DISTINCT item, id FROM (
    SELECT a.item, a.id, a.pos FROM near a JOIN near b ON a.item = b.item AND a.id = b.id AND b.pos BETWEEN a.pos AND a.pos + 39
    GROUP BY a.item, a.id, a.pos HAVING count(DISTINCT b.term) = 5)),
prox AS (SELECT id, count(*) AS n_near_items FROM close GROUP BY id)
SELECT w.id AS doc_id, len(w.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM w LEFT JOIN hit ON w.id = hit.id LEFT JOIN its ON w.id = its.id LEFT JOIN prox ON w.id = prox.id
WHERE w.kind = 'd'
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark matches of every document."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), "n_near_items")


REGISTRY["op10_decontamination"] = (op10_decontamination, OP10_SQL)
