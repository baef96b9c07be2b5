"""URL filter: host/path rules first, then logistic regression on hashed character n-grams.

The model is trained on a small labelled URL table (here: URLs that the rules decide, at most
``TRAIN_ROWS`` of them, taken by hash).  Features are the character n-grams of host and path, marked with
where they stand, hashed to ``FEATURES`` columns.  N-grams are Spark array expressions; hashing, fitting and
scoring are Spark ML stages that run in the JVM (no Python on the executors).

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the model's
verdict for no features; repeated rows get equal results; a null id is carried through; other columns are
ignored; an empty table gives an empty result; with one label only, every undecided url gets that label,
and ``allow`` when nothing is labelled.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4)
FEATURES = 1 << 14
TRAIN_ROWS = 4000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (a list given in the call, tried from the longest on), as (verdict, rule)."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _pieces(framed: Column, mark: str, n: int) -> Column:
    """All pieces of ``n`` characters, behind their mark."""
    # one parameter only: a second one, a default too, would be given the position in the array
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))),
                         lambda i: F.concat(F.lit(mark), framed.substr(i, F.lit(n))))
    return F.when(F.length(framed) >= n, pieces).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, mark: str, sizes=SIZES) -> Column:
    """N-grams of ``^text$``, each marked with the part of the url it comes from."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*[_pieces(framed, mark, n) for n in sizes])


def featured(urls: DataFrame) -> DataFrame:
    """Adds the hashed n-gram vector of ``host`` and ``path``."""
    grams = urls.withColumn("__grams", F.concat(ngrams(F.col("host"), "h"), ngrams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__x").transform(grams).drop("__grams")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS):
    """Model of ``(host, path, label)`` (label 1: block) on at most ``rows`` distinct rows, taken in the order
    of their hash; a float when there is nothing to separate (the block probability of every url)."""
    sample = cut(labelled.select("host", "path", "label").distinct()
                 .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(rows))
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}  # two labels
    if len(counts) < 2:
        return float(next(iter(counts), 0.0))
    return LogisticRegression(featuresCol="__x", labelCol="label", regParam=0.01, maxIter=50).fit(featured(sample))


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule (null: none fits), verdict and ``score``, the model's
    probability of ``block``.  ``labelled`` has host, path and label; by default the rules label the urls."""
    url = F.col(url_col)
    urls = (pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
            .withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)))
    if labelled is None:
        labelled = urls.where("__rule IS NOT NULL").select("host", "path", (F.col("__rule.verdict") == "block").cast("double").alias("label"))
    model = train(labelled)
    if isinstance(model, float):
        scored = urls.withColumn("score", F.lit(model))
    else:
        model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__pred")
        scored = model.transform(featured(urls)).withColumn("score", vector_to_array("__p")[1])
    judged = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"),
                         F.coalesce(F.col("__rule.verdict"), judged).alias("verdict"), F.round("score", 6).alias("score"))
