"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The cells' token counts are raked in turn to the
target shares of the three margins until every margin value is within ``TOLERANCE`` of its target (relative);
targets that cannot be met together stop after ``MAX_ROUNDS`` with a warning that tells the largest error.  The
result divided by a cell's tokens, scaled to the token budget, is how often each of its documents should be drawn.  A document is taken ``floor(r)`` times,
and once more with probability ``r - floor(r)`` by a hash of its id: the same draw on any cluster.

Target shares of a margin are given, or else its values' token shares raised to a power (``SHAPES``) and
scaled to one: power 1 keeps a margin as it is, 0 makes its values equal.  Topics come from a column of the
caller (``topic_col``); without one, the topic is the bucket of the document's most frequent word of five bytes or
more (ties: the smallest in byte order; none: bucket -1).

The corpus is aggregated once to cells (partial sums, so a source with a third of all rows is a few rows
per task); all raking runs on the cell table.  A cell table counted to be at most ``LOCAL_CELLS`` rows is raked as
arrays; a larger one stays distributed: a margin's sums are partial aggregates, joined back by value, so no margin
value's cells meet in one task.  Both ways take the same steps.  Sums and cells are broadcast only when counted small.

Defined cases: null source or language are values of their own; a null or empty text has no tokens and is
never drawn; rows with a null id are drawn by the hash of an empty id; repeated rows get equal results;
other columns are kept, those named like an output (``OUTPUTS``) as ``input_<name>``; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import warnings
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import aside, broadcast_if_small, cut, small_batches, stage
from panelkit.operators.common import join_on

TOLERANCE, MAX_ROUNDS = 1e-12, 200
LOCAL_CELLS = 200_000
OUTPUTS = ("topic", "n_tokens", "expected_copies", "n_copies")
SHAPES = {"source": 0.5, "lang": 0.5, "topic": 0.0}
TOPICS, MIN_BYTES = 8, 5
BUDGET = 0.5  # of the corpus' tokens


def topic_of(text: str | None) -> tuple[int, int]:
    """(topic bucket, words) of a text."""
    words = text.encode().lower().split() if text else []
    times = Counter(w for w in words if len(w) >= MIN_BYTES)
    if not times:
        return -1, len(words)
    most = max(times.values())
    word = min(w for w, n in times.items() if n == most)
    return int(hashlib.md5(word).hexdigest()[:8], 16) % TOPICS, len(words)


def with_topics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``topic`` and ``n_tokens``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("topic int, n_tokens long")
    def look(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([topic_of(t) for t in texts], columns=["topic", "n_tokens"])

    return (docs.withColumn("__seen", look(F.col(text_col)))
            .withColumn("topic", F.col("__seen.topic")).withColumn("n_tokens", F.col("__seen.n_tokens")).drop("__seen"))


def _given(margin: str, shares: dict) -> Column:
    """The given target share of a cell's margin value (0 for a value that is not given)."""
    total, out = float(sum(shares.values())), F.lit(0.0)
    for value, share in shares.items():
        out = F.when(F.col(margin).eqNullSafe(F.lit(value)), F.lit(share / total)).otherwise(out)
    return out


def _fit(cells: pa.Table, margins, tolerance: float, max_rounds: int) -> tuple[np.ndarray, float]:
    """Raked weights of a bounded cell table, and the largest margin error left."""
    codes = [cells[m].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for m in margins]
    goals = [cells[f"t_{m}"].to_numpy() for m in margins]
    w, error = cells["tokens"].to_numpy().copy(), 0.0
    for _ in range(max_rounds if len(w) else 0):
        for code, goal in zip(codes, goals, strict=True):
            s = np.bincount(code, w)[code]
            w = np.divide(w * goal, s, out=np.zeros_like(w), where=s > 0)
        error = max(float(np.max(np.abs(np.bincount(c, w)[c] - g)[g > 0] / g[g > 0], initial=0.0)) for c, g in zip(codes, goals, strict=True))
        if error <= tolerance:
            break
    return w, error


def margin_error(now: DataFrame, margins) -> float:
    """Largest relative distance of a margin value's share from its target (targets of zero are met at once)."""
    each = [now.groupBy(m).agg(F.sum("w").alias("s"), F.first(f"t_{m}").alias("t")).select("s", "t") for m in margins]
    total = F.abs(F.col("s") - F.col("t")) / F.col("t")
    return reduce(DataFrame.unionAll, each).where("t > 0").agg(F.max(total)).first()[0] or 0.0


def raked(cells: DataFrame, margins=("source", "lang", "topic"), targets: dict | None = None, shapes: dict = SHAPES,
          tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The cells (margin columns, ``tokens``) with ``w``: raked shares, one in total."""
    now = cells.where("tokens > 0").select(*margins, F.col("tokens").cast("double").alias("tokens"))
    n_values = now.agg(*[F.count_distinct(F.coalesce(F.col(m).cast("string"), F.lit(""))).alias(m) for m in margins]).first()
    for m in margins:
        if targets and m in targets:
            now = now.withColumn(f"t_{m}", _given(m, targets[m]))
            continue
        # one row per margin value first: shares of values, not of cells
        values = now.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(float(shapes[m]))).alias("p"))
        total = values.agg(F.sum("p").alias("s"))
        values = values.join(F.broadcast(total)).select(m, (F.col("p") / F.col("s")).alias(f"t_{m}"))  # total is one row
        now = join_on(now, values, [m])
    now = cut(now.withColumn("w", F.col("tokens")))
    error = 0.0
    if now.count() <= LOCAL_CELLS:
        held = now.drop("w").toArrow()
        w, error = _fit(held, margins, tolerance, max_rounds)
        now = now.sparkSession.createDataFrame(held.append_column("w", pa.array(w)), now.schema)
    else:
        for _ in range(max_rounds):
            for m in margins:
                sums = now.groupBy(m).agg(F.sum("w").alias("__s"))
                now = join_on(now, broadcast_if_small(sums, n_values[m] + 1), [m])
                # a written table: a checkpoint would carry the joins' constraints on, and they grow with every round
                now = stage(now.withColumn("w", F.when(F.col("__s") > 0, F.col("w") * F.col(f"t_{m}") / F.col("__s"))
                                           .otherwise(F.lit(0.0))).drop("__s"), "raking")
            error = margin_error(now, margins)
            if error <= tolerance:
                break
    if error > tolerance:
        warnings.warn(f"raking stopped after {max_rounds} rounds, a margin value is off by {error:.2g} of its target", stacklevel=2)
    return now.select(*margins, "tokens", "w")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins=("source", "lang", "topic"),
        targets: dict | None = None, shapes: dict = SHAPES, budget: float = BUDGET, topic_col: str | None = None) -> DataFrame:
    """The documents with ``topic``, ``n_tokens``, ``expected_copies`` and ``n_copies`` (0: not drawn)."""
    docs, given = aside(docs, OUTPUTS)
    seen = with_topics(docs, text_col)
    if topic_col is not None:
        seen = seen.withColumn("topic", F.col(given.get(topic_col, topic_col)))
    cells = cut(seen.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weights = cut(raked(cells, margins, targets, shapes)
                  .select(*margins, (F.col("w") * F.lit(float(budget) * float(total)) / F.col("tokens")).alias("expected_copies")))
    out = join_on(seen, broadcast_if_small(weights, weights.count()), list(margins), "left")
    # rounded so that the last bits of the raking do not matter
    r = F.floor(F.coalesce("expected_copies", F.lit(0.0)) * 1e6 + 0.5) / 1e6
    r = F.when(F.col("n_tokens") > 0, r).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (out.withColumn("expected_copies", r)
            .withColumn("n_copies", (F.floor("expected_copies") + F.when(draw < F.col("expected_copies") - F.floor("expected_copies"), 1).otherwise(0)).cast("long")))
