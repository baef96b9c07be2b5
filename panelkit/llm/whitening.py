"""Whitening of embeddings: leading components of a distributed, centred covariance.

Entries become whole numbers x = floor(64 c) + 1000000 (parameters ``SCALE``, ``OFFSET``).  The fit list holds
each distinct x vector once, so copies do not pull the components.

1. The distinct vectors are stored (a hash aggregate that combines copies before the shuffle).
2. Their number n and exact sums S: per task, summed in two halves so that no long overflows.
3. Covariance, divisor n: every task centres its vectors by S / n (whole part first, so nothing is lost) and
   adds up its products; a task returns one d x d matrix, and rows of these matrices are added on Spark.  The
   driver holds one d x d matrix.
4. Eigenvectors: ``eigen.leading_eigenvectors`` (Householder, Sturm bisection, inverse iteration).  Components
   whose eigenvalue is under ``LEAST`` times the largest have no variance to speak of and are left out, so
   vectors of few dimensions, few distinct vectors or a single one give fewer components or none.
5. The d x k projection is broadcast (its size depends on d and k only), and the whitened fit list is measured
   once more against the identity.

Defined cases: rows with a null vector, a null or non-finite entry are dropped; a row with a null id is kept.
The dimension is the most frequent length, the longer of equals; vectors of another length and empty ones are
dropped.  Entries whose x is beyond 2**52 count as +-2**52.  ``deviation`` is null where it does not fit a
long.  Repeated rows each get their result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import stage
from panelkit.llm.eigen import leading_eigenvectors

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LEAST = 1e-11
LIMIT, HALF = 2**52, 26
ROWS = 4096  # vectors handled at a time in a task


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``base`` + ``rest`` / ``n`` is the mean (whole part and exact remainder)."""
    n: int
    base: np.ndarray
    rest: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray  # d x k, unit columns
    total: float  # trace of the covariance
    identity_error: float | None = None

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.total if self.total else self.eigenvalues

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def whole(c: Column) -> Column:
    """x of an entry."""
    x = F.floor(c.cast("double") * SCALE + F.lit(float(OFFSET)))  # whole numbers up to 2**52 are exact
    return F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)).cast("long")


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``x`` of the rows that take part, but for their dimension."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bound = F.lit(float(2**46))
    return (df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine & (F.size(v) > 0))
            .select("id", F.transform(v, lambda c: whole(F.greatest(F.least(c, bound), -bound))).alias("x")))


def _matrices(batches, d: int):
    """Blocks of vectors of dimension ``d`` as (batch part, n x d array)."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            x = part.column(part.schema.get_field_index("x"))
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches):
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _matrices(batches, d):
            n += len(x)
            low += (x & ((1 << HALF) - 1)).sum(axis=0)
            high += (x >> HALF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                          "low": pa.array(low), "high": pa.array(high)})

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = (fit.mapInArrow(run, "i int, n long, low long, high long").groupBy("i")
            .agg(F.sum("n").alias("n"), exact("low").alias("low"), exact("high").alias("high")).collect())  # d rows
    rows = sorted(rows, key=lambda r: r["i"])
    return (rows[0]["n"] if rows else 0), [int(r["low"]) + (int(r["high"]) << HALF) for r in rows]


def _products(fit: DataFrame, d: int, k: int, centred) -> np.ndarray:
    """Sum of the outer products of ``centred(x)``, k x k: one matrix a task, rows added on Spark."""
    def run(batches):
        total = np.zeros((k, k))
        for _, x in _matrices(batches, d):
            y = centred(x)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(k), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    rows = (fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())  # k x k numbers
    out = np.zeros((k, k))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fits the whitening to the distinct vectors ``x`` of dimension ``d`` (a stored table)."""
    n, sums = _sums(fit, d)
    if n == 0:
        return Whitening(0, np.zeros(d, np.int64), np.zeros(d, np.int64), np.empty(0), np.empty((d, 0)), 0.0)
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    mean = rest / n

    def centre(x):
        return (x - base) - mean

    v = _products(fit, d, d, centre) / n
    values, vectors = leading_eigenvectors(v, components)
    some = values > LEAST * max(values[0], 0.0) if len(values) else np.empty(0, bool)
    model = Whitening(n, base, rest, values[some], vectors[:, some], float(np.trace(v)))
    k = len(model.eigenvalues)
    if not k:
        return model
    projection = fit.sparkSession.sparkContext.broadcast(model.projection)
    w = _products(fit, d, k, lambda x: centre(x) @ projection.value) / n
    return Whitening(model.n, base, rest, model.eigenvalues, model.components, model.total, float(np.abs(w - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sum of (n x - S)^2 of each row, exactly; null where a long does not hold it."""
    far = max(int(np.abs(x - base).max(initial=0)), 1)
    if x.shape[1] * ((far + 1) * n) ** 2 < 2**63:
        y = n * (x - base) - rest
        return pa.array((y * y).sum(axis=1))
    y = n * (x - base).astype(object) - rest.astype(object)
    return pa.array([s if s < 2**63 else None for s in (y * y).sum(axis=1)], pa.int64())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """``(rows, model)``: per row that takes part its id, ``deviation`` and ``whitened`` (one number a component,
    in the order of ``model.eigenvalues``)."""
    rows = quantised(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 1
    rows = rows.where(F.size("x") == d)
    model = fit_whitening(stage(rows.select("x").distinct(), "distinct-vectors"), d, components)
    n, base, rest, k = model.n, model.base, model.rest, len(model.eigenvalues)
    mean = rest / max(n, 1)
    projection = df.sparkSession.sparkContext.broadcast(model.projection)

    def run(batches):
        for part, x in _matrices(batches, d):
            w = ((x - base) - mean) @ projection.value
            flat = pa.array(w.ravel())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), deviations(x, n, base, rest),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)], [id_col, "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, deviation long, whitened array<double>"), model
