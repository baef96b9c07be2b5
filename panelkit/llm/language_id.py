"""Language identification: nearest centroid of TF-IDF character n-gram vectors.

Text is lower-cased, ASCII non-letters become spaces, and its 1- to 3-grams of code points are hashed into
``DIMS`` columns; weights are ``log(1 + count) * idf``, vectors have length one.  Document frequencies come
from all training rows.  For the centroids, at most about ``PER_LANG`` training rows of each label (taken by
hash of the id) are clustered by spherical k-means, ``CLUSTERS`` centroids a label.  A text gets the label
of the centroid with the largest cosine.  Rejection is by distance: each centroid keeps the distance below
which ``KEEP_SHARE`` of its own training rows lie, with ``SLACK`` on top; a text farther from its nearest
centroid than that is marked ``rejected`` (its nearest label is still reported).

Bounds: the sample is ``PER_LANG`` rows a label (twice that at the very most), the number of labels is checked
(``MAX_LANGS``), the document frequencies are ``DIMS`` numbers and the model ``MAX_LANGS * CLUSTERS`` vectors.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts are read whole; rows
with a null label are predicted but not learned from; repeated rows get equal results; a null id is carried
through (and not held out); other columns are ignored; an empty table gives an empty result, and without any
training row everything is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import map_columns, small_batches
from panelkit.operators.common import bounded_collect

BITS = 13
DIMS = 1 << BITS
PER_LANG, MAX_LANGS = 800, 500
CLUSTERS, ROUNDS = 3, 15
KEEP_SHARE, SLACK = 0.995, 0.05
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_KEY = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_SPACED = np.array([32 if not (97 <= c <= 122) else c for c in range(128)], np.uint32)
_SLICE = 1 << 22


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a text."""
    out = np.zeros(DIMS, np.int64)
    if not text:
        return out
    whole = text.lower()
    for i in range(0, len(whole), _SLICE):  # two characters over, so that no n-gram is lost
        part = whole[i:i + _SLICE + 2]
        last = i + _SLICE >= len(whole)
        a = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        a = np.where(a < 128, _SPACED[np.minimum(a, 127)], a)
        h = np.zeros(len(a), np.uint32)
        for n in range(3):
            m = len(a) - n
            if m <= 0:
                break
            h = (h[:m] ^ a[n:]) * _KEY[n]
            found = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)
            out += np.bincount(found if last else found[:_SLICE], minlength=DIMS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (zero rows stay zero)."""
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of the documents each column occurs, and the number of documents; each task sums first."""
    arrow_schema = "slot int, df long"
    small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += gram_counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS), pa.int32()), pa.array(np.append(df[at], n), pa.int64())],
                                         names=["slot", "df"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, arrow_schema).groupBy("slot").agg(F.sum("df").alias("df"))
    out = np.zeros(DIMS + 1, np.int64)
    for r in bounded_collect(rows, DIMS + 1, "document frequencies"):
        out[r.slot] = r.df
    return out[:DIMS], int(out[DIMS])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts from the row nearest the mean, then the rows farthest from all starts."""
    starts = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    centres = x[starts]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        per_lang: int = PER_LANG, clusters: int = CLUSTERS):
    """``(labels of the centroids, centroids, greatest distances, idf)``, or None without training rows."""
    langs = bounded_collect(train.groupBy(label_col).count(), MAX_LANGS, "labels")
    if not langs:
        return None
    df, n = document_frequencies(train, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)
    share = F.create_map(*[F.lit(v) for r in langs for v in (r[label_col], min(1.0, per_lang / r["count"]))])
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < F.get(F.map_values(F.map_filter(
        share, lambda key, _: key == F.col(label_col))), F.lit(0)) * 1_000_000
    sample = train.where(part).select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def vectors(label, id, text):  # noqa: A002
        counts = [gram_counts(t) for t in text]
        at = [np.flatnonzero(c) for c in counts]
        return {"label": label, "id": id, "slots": at, "counts": [c[i] for c, i in zip(counts, at, strict=True)]}

    sparse = map_columns(sample, vectors, f"label string, id {sample.select('id').schema[0].dataType.simpleString()}, slots array<long>, counts array<long>")

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").head(2 * per_lang)
        counts = np.zeros((len(pdf), DIMS), np.float32)
        for i, (a, c) in enumerate(zip(pdf["slots"], pdf["counts"], strict=True)):
            counts[i, a] = c
        x = weighted(counts, idf)
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"label": [], "centre": [], "far": []})
        c = spherical_kmeans(x, clusters)
        cos = x @ c.T
        near = cos.argmax(axis=1)
        far = [1 - np.quantile(cos[near == j, j], 1 - KEEP_SHARE) if (near == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "centre": list(c.astype(np.float64)), "far": np.asarray(far, float) + SLACK})

    rows = bounded_collect(sparse.groupBy("label").applyInPandas(centres, "label string, centre array<double>, far double"),
                           MAX_LANGS * clusters, "centroids")
    rows.sort(key=lambda r: (r.label, r.centre))
    if not rows:
        return None
    return [r.label for r in rows], np.array([r.centre for r in rows], np.float32), np.array([r.far for r in rows]), idf


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (largest cosine), ``rejected``."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(**cols):
        texts = cols["__text"]
        pred, score, rejected = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if sent.value is not None and at:
            labels, centroids, far, idf = sent.value
            cos = weighted(np.stack([gram_counts(texts[i]) for i in at]), idf) @ centroids.T
            best = cos.argmax(axis=1)
            for i, j, c in zip(at, best, cos[np.arange(len(at)), best], strict=True):
                pred[i], score[i], rejected[i] = labels[j], round(float(min(max(c, 0), 1)), 6), bool(1 - c > far[j])
        return {id_col: cols[id_col], "lang_pred": pred, "score": score, "rejected": rejected}

    return map_columns(docs.select(id_col, F.col(text_col).alias("__text")), run,
                       f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
