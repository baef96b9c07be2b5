"""Benchmark decontamination with a distributed positional inverted index (DataFrame operations only).

* Index: one posting ``(term, doc, pos)`` for every training word, stored as Parquet; it depends on the documents
  only, so one index serves any benchmark (``contamination(..., index=)``).  A last posting with the empty term
  holds each document's number of words.
* Search: in every window of ``WINDOW`` item words the rarest term (by corpus frequency) is probed.  A hit
  fixes the alignment ``diag = doc position - item position``.  The list of the window's second rarest term,
  adjusted by its offset, is intersected with it; only alignments found in both go on.
* Exact phrases: around every alignment left, the item's words are looked up at their adjusted positions;
  a run of at least ``WINDOW`` consecutive matches (or the whole of a shorter item) is a match.
* Proximity: the ``NEAR_TERMS`` rarest terms of an item, all within ``NEAR_SPAN`` document words.

A window with a word that no document has is not searched.  Only postings of rare terms and of the few
documents with surviving alignments are shuffled; a term in every document is never probed unless its whole
window is that common, and then its postings are dealt by document, not by term.

Defined cases: null texts have no words (and never match); items without words match nothing; rows with a
null id are reported without hits; rows that share an id are searched as one document; repeated items and
items that share an id count once by id; other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import broadcast_if_small, cut, entries, stage

WINDOW = 10
NEAR_TERMS, NEAR_SPAN = 5, 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing A-Z


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAPS, -1), "")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, n, at, term)``; ``item`` is (id, digest of the text), so that two texts of one id stay apart."""
    return (items.where(F.col(text_col).isNotNull()).select(
                F.struct(F.col(id_col).alias("id"), F.md5(text_col).alias("text")).alias("item"), words_of(F.col(text_col)).alias("w"))
            .distinct().select("item", F.size("w").alias("n"), F.posexplode("w").alias("at", "term")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings ``(term, doc, pos)`` of all words, and a posting ``('', doc, n_words)``."""
    words = F.concat(F.coalesce(words_of(F.col(text_col)), F.array().cast("array<string>")), F.array(F.lit("")))
    return stage(docs.select(F.col(id_col).alias("doc"), F.posexplode(words).alias("pos", "term")).select("term", "doc", "pos"), "postings")


def frequencies(index: DataFrame, words: DataFrame) -> DataFrame:
    """The item words with the corpus frequency of their terms (0 included)."""
    terms = cut(words.select("term").distinct())
    cf = (index.join(broadcast_if_small(terms, terms.count()), "term", "left_semi")
          .groupBy("term").agg(F.count(F.lit(1)).alias("cf")))
    return cut(words.join(cf, "term", "left").na.fill(0, ["cf"]).select("item", "n", "at", "term", "cf"))


def _lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Postings of the probes' terms, as alignments: ``(item, doc, diag, at)``."""
    probes = cut(probes)
    return (index.join(broadcast_if_small(probes, probes.count()), "term")
            .where(F.col("doc").isNotNull()).select("item", "doc", (F.col("pos") - F.col("at")).alias("diag"), "at"))


def phrase_matches(index: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches ``(item, doc, start, stop)``: document words start..stop-1 equal consecutive item words;
    every occurrence of a window lies in one of them.  ``words`` comes from ``frequencies``."""
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    rank = F.struct("cf", "term", "at")
    wins = (words.withColumn("w", F.array_sort(F.collect_list(rank).over(ahead)))
            .where((F.col("at") + window <= F.col("n")) | ((F.col("at") == 0) & (F.col("n") < window)))
            .where(F.col("w")[0]["cf"] > 0)
            # a window of one word has no second term: the first stands for both
            .select("item", F.col("w")[0].alias("a"), F.coalesce(F.get("w", F.lit(1)), F.col("w")[0]).alias("b")))
    pairs = cut(wins.distinct())
    first = _lookup(index, pairs.select("item", F.col("a.term").alias("term"), F.col("a.at").alias("at")).distinct())
    second = _lookup(index, pairs.select("item", F.col("b.term").alias("term"), F.col("b.at").alias("at")).distinct())
    offsets = pairs.select("item", F.col("a.at").alias("at"), F.col("b.at").alias("at2")).distinct()
    both = (first.join(broadcast_if_small(offsets, pairs.count()), ["item", "at"])
            .join(second.withColumnRenamed("at", "at2"), ["item", "doc", "diag", "at2"]))
    found = cut(both.select("item", "doc", "diag").distinct())

    # The item's words at their adjusted positions, against the postings of the documents still in.
    n_found = found.count()
    near_by = found.select("doc").distinct()
    postings = index.join(broadcast_if_small(near_by, n_found), "doc", "left_semi")
    small = words.select("item", "n", "at", "term")
    expected = (found.join(broadcast_if_small(small, words.count()), "item")
                .select("item", "doc", "diag", "n", "at", "term", (F.col("diag") + F.col("at")).cast("int").alias("pos")))
    met = expected.join(postings, ["doc", "pos", "term"]).select("item", "doc", "diag", "n", "at").distinct()
    in_line = Window.partitionBy("item", "doc", "diag").orderBy("at")
    return (met.withColumn("run", F.col("at") - F.row_number().over(in_line))
            .groupBy("item", "doc", "diag", "n", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
            .where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n")))
            .select("item", "doc", (F.col("diag") + F.col("a")).alias("start"), (F.col("diag") + F.col("b") + 1).alias("stop")))


def proximity_matches(index: DataFrame, words: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """``(item, doc)`` where the item's ``terms`` rarest terms (of those that the corpus has; ties by term)
    all stand within ``span`` consecutive words.  Items with fewer such terms have no proximity match."""
    by_rarity = Window.partitionBy("item").orderBy("cf", "term")
    rare = (words.where("cf > 0").select("item", "term", "cf").distinct()
            .withColumn("k", F.row_number().over(by_rarity)).where(F.col("k") <= terms))
    full = cut(rare.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item"))).where(F.col("m") == terms).select("item", "term"))
    spots = (index.join(broadcast_if_small(full, full.count()), "term").where(F.col("doc").isNotNull()).select("item", "doc", "pos", "term"))
    ahead = Window.partitionBy("item", "doc").orderBy("pos").rangeBetween(0, span - 1)
    return (spots.withColumn("m", F.size(F.collect_set("term").over(ahead))).where(F.col("m") == terms)
            .select("item", "doc").distinct())


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", near: bool = True, index: DataFrame | None = None) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside matched windows), ``item_ids`` (sorted as
    strings) and, unless ``near`` is off, ``n_near_items`` (items with a proximity match).  ``index`` is what
    ``build_index`` gave for the same documents."""
    if index is None:
        index = build_index(docs, id_col, text_col)
    words = frequencies(index, cut(item_words(items)))
    matches = cut(phrase_matches(index, words, window))
    hit = (matches.select("doc", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct()
           .groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit")))
    by_item = (matches.select("doc", F.col("item.id").cast("string").alias("id")).distinct()
               .groupBy("doc").agg(F.array_sort(F.collect_list("id")).alias("item_ids")))
    hits = hit.join(by_item, "doc")
    if near:
        close = (proximity_matches(index, words).select("doc", "item.id").distinct()
                 .groupBy("doc").agg(F.count(F.lit(1)).alias("n_near_items")))
        hits = hits.join(close, "doc", "full")
    hits = cut(hits)
    out = (index.where("term = ''").select("doc", F.col("pos").cast("long").alias("n_words"))
            .join(broadcast_if_small(hits, entries(hits, "item_ids")), "doc", "left")
            .select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    *([F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items")] if near else [])))
    return out
