"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelkit.session import ensure_checkpoint_dir, scratch_path

# ASCII white space: every word rule below splits at these characters only.
WS = " \t\n\x0b\x0c\r"
# Rows of one Arrow batch handed to Python: documents can be long, so far fewer than the default.
BATCH_ROWS = 512
# A table is broadcast only when it was counted and is at most this many rows of bounded width.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches (a batch of 10,000 long documents is more than a worker's memory)."""
    with contextlib.suppress(Exception):
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """``fn(**columns as lists) -> {column: list}`` over Arrow batches of ``df``; one call per batch."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(**{n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and go on from the files: computed
    once, lineage cut, read again with column pruning, safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` to the shared folder, for small iterative state."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the caller's columns named like an operator's output renamed to ``input_<name>`` (``input_`` again
    while that is taken), and the names given."""
    taken, given = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in names:
            new = f"input_{c}"
            while new.lower() in taken:
                new = f"input_{new}"
            taken.add(new.lower())
            given[c] = new
    return (df.withColumnsRenamed(given) if given else df), given


def entries(df: DataFrame, lists: str) -> int:
    """Rows of a stored table plus the entries of its array column: what a broadcast of it would carry."""
    return df.agg(F.coalesce(F.sum(F.greatest(F.size(lists), F.lit(0)) + 1), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a count; beyond the limit the join shuffles."""
    return F.broadcast(df) if rows <= limit else df
