"""Registered queries: quality rules, secret scan, token counts, line deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import table
from panelkit.llm.line_dedup import dedup_lines
from panelkit.llm.near_dedup import near_duplicates
from panelkit.llm.quality import quality_verdicts
from panelkit.llm.secret_scan import secret_report
from panelkit.llm.substring_dedup import dedup_substrings
from panelkit.llm.token_count import count_tokens

REGISTRY: dict = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return put


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 9)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM again WHERE n > 1) GROUP BY doc_id),
s AS (
  SELECT base.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[*•-]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base LEFT JOIN rep ON base.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_digits > 25 * word_chars
            OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_bullet_lines > 90 * n_lines
            OR 100 * n_ellipsis_lines > 30 * n_lines) AS kept
FROM s
"""


@register("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base verdict and the cascade's verdict of every document."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (quality_verdicts(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), "kept"))


@register("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the result needs offsets of overlapping kinds, so no SQL (tested against
    Python's regex engine)."""
    return secret_report(table(spark, sf_dir, "documents"))


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document (tested against the ``tokenizers`` library)."""
    return count_tokens(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)),
f AS (
  SELECT doc_id, pos, row_number() OVER w AS k, line, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM l WHERE filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, k) AS rn
    FROM f WHERE c IS NOT NULL) WHERE rn > 1),
gone AS (
  SELECT DISTINCT f.doc_id, f.pos
  FROM (SELECT doc_id, k + unnest([0, 1, 2]) AS k FROM later) g JOIN f ON f.doc_id = g.doc_id AND f.k = g.k),
r AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS kept
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
OP9_SQL = f"SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM ({LINES_SQL})"


@register("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its line counts and the digest of what is left of its text."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def near_sql(k: int) -> str:
    """Exact similarity join on ``k``-word shingles and the components of its links."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + least({k}, len(ws)) - 1) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
reach AS (
  SELECT doc_id AS id, doc_id AS x FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.x = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT id, min(x) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


@register("op5_minhash_near_dedup", near_sql(4))
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (4-word shingles, similarity 0.8)."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM b WHERE length(h) >= 100)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5_number(g)) AS first FROM win) WHERE first < doc_id),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY doc_id, run),
gaps AS (
  SELECT r.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before FROM runs r),
kept AS (
  SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(max(h), 2 * max(z) + 1) AS k
  FROM gaps g JOIN b ON g.doc_id = b.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM b LEFT JOIN kept ON b.doc_id = kept.doc_id
"""


@register("op4_suffix_dedup", OP4_SQL)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of smaller documents cover; counts and digest of the spans
    and of the bytes left."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
