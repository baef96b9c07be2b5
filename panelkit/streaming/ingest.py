"""Incremental ACS ingest with Structured Streaming.

``start_acs_ingest`` watches ``watch_dir`` with the ``binaryFile`` source
(only path metadata is selected, so file contents are not loaded by the
stream itself), and for every micro-batch scans the new files with
``panelkit.sources.acs.scan_cells`` and appends the unmerged cells (with
their (path, row, column) order) to a Parquet log partitioned by year.
Only the micro-batch's file paths reach the driver (bounded by
``maxFilesPerTrigger``).  The stream's own checkpoint keeps track of the
files already processed, so a restarted query resumes where it stopped, and
a replayed batch rewrites its own output (``batch_id`` partition column plus
dynamic partition overwrite), which keeps the log free of duplicates.

``read_ingested`` merges the log exactly as the batch scan does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import scratch_path
from panelkit.sources import acs


def start_acs_ingest(spark: SparkSession, watch_dir: str, log_dir: str, file_glob: str = "*-Data.csv",
                     variables=None, checkpoint_location: str | None = None,
                     max_files_per_trigger: int = 1000, available_now: bool = False):
    files = (spark.readStream.format("binaryFile")
             .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
             .option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob)
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(watch_dir).select("path"))

    def ingest(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        if not paths:
            return
        cells = acs.scan_cells(batch.sparkSession, watch_dir, variables, file_glob, paths=paths)
        (cells.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(log_dir))

    writer = (files.writeStream.foreachBatch(ingest)
              .option("checkpointLocation", checkpoint_location or scratch_path(spark, "stream-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_ingested(spark: SparkSession, log_dir: str, null_sentinels=()) -> DataFrame:
    """Merged ``(geo_id, year, variable, value)`` from the cell log."""
    return acs.observations(spark.read.parquet(log_dir).drop("batch_id"), null_sentinels)
