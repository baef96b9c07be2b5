"""Line deduplication by overlapping three-line windows.

A window is three consecutive lines of a document that hold more than white space (blank lines between them
are passed over and always stay).  Windows are hashed (MD5, 128 bits); a window that occurs more than once
in the whole corpus keeps its first occurrence by (id, position) and all later occurrences are removed: a
line goes when any removed window covers it.  Overlapping windows merge by their covered positions.

Only hashes are shuffled: counting is partial before the shuffle, so a window in a third of all documents is
a few rows; the join back is on a table with one row per repeated window (broadcast only when counted small,
else a shuffle join of two plain exchanges, whose hot keys Spark splits).

Defined cases: null or empty texts, documents of fewer than three such lines and rows with a null id stay as
they are; rows that share id and text are the same occurrence and get the same result; other columns pass
through untouched, those named ``n_lines`` or ``n_removed`` as ``input_n_lines``, ``input_n_removed``; an empty
table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import WS, aside, broadcast_if_small, entries, small_batches, stage

LINES = 3
OUTPUTS = ("n_lines", "n_removed")
FILLED = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.split(text, "\n", -1)


def _cut(texts: pd.Series, removed: pd.Series, k: pd.Series) -> pd.DataFrame:
    """Texts without the lines that the removed windows cover, and how many those are."""
    out = []
    for text, starts, size in zip(texts, removed, k, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(WS)]
        gone = {filled[j + d] for j in starts for d in range(size)}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return pd.DataFrame(out, columns=["text", "n"])


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = LINES) -> DataFrame:
    """``(doc, at, key)``: ``at`` counts filled lines, ``key`` hashes lines at..at+k-1."""
    split = (docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
           .select(F.col(id_col).alias("doc"), _lines(F.col(text_col)).alias("lines"))
           .select("doc", F.filter("lines", lambda x: x.rlike(FILLED)).alias("lines"))
           .where(F.size("lines") >= k))
    keys = F.transform(F.sequence(F.lit(0), F.size("lines") - k),
                       lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, k), "\n"))))
    return split.select("doc", F.posexplode(keys).alias("at", "key"))


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = LINES) -> DataFrame:
    """``(doc, removed)``: the window positions of a document that are later occurrences."""
    windows = stage(line_windows(docs, id_col, text_col, k), "line-windows")
    first = stage(windows.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").select("key", "first"), "line-repeats")
    later = (windows.join(broadcast_if_small(first, first.count()), "key")
             .where(F.struct("doc", "at") != F.col("first")))
    return later.groupBy("doc").agg(F.collect_set("at").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = LINES) -> DataFrame:
    """The documents with repeated windows cut out of the text, plus ``n_lines`` and ``n_removed`` (lines)."""
    gone = stage(removed_windows(docs, id_col, text_col, k)
                 .withColumnsRenamed({"doc": "__doc", "removed": "__removed"}), "line-removed")
    docs, _ = aside(docs, OUTPUTS)
    kept = docs.join(broadcast_if_small(gone, entries(gone, "__removed")), F.col(id_col) == F.col("__doc"), "left")
    # only texts that lose lines go through Python
    hit = F.col("__removed").isNotNull()
    small_batches(docs.sparkSession)
    cut = F.pandas_udf(_cut, "text string, n long")
    return (kept.withColumn("__cut", cut(F.when(hit, F.col(text_col)), F.col("__removed"), F.lit(k)))
            .withColumn("n_lines", F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0)).cast("long"))
            .withColumn("n_removed", F.col("__cut.n"))
            .withColumn(text_col, F.when(hit, F.col("__cut.text")).otherwise(F.col(text_col)))
            .drop("__doc", "__removed", "__cut"))
