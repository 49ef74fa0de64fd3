"""Following a signal: a streaming query over the landing folder with the lookup filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.operators import lookups
from spanforge.sources import flatten

BATCH_SCHEMAS = {
    "traces": schema.RESOURCE_SPANS,
    "logs": schema.RESOURCE_LOGS,
    "metrics": schema.RESOURCE_METRICS,
}
FLATTEN = {
    "traces": flatten.flatten_traces,
    "logs": flatten.flatten_logs,
    "metrics": flatten.flatten_metrics,
}
MATCH = {
    "traces": lookups.match_spans,
    "logs": lookups.match_logs,
    "metrics": lookups.match_metrics,
}


def read_batches(
    spark: SparkSession,
    folder: str,
    signal: str,
    file_format: str = "parquet",
    max_files: int = 1_000,
    arrived_after: dt.datetime | None = None,
) -> DataFrame:
    """Nested batches landing in a folder, as a stream.

    ``max_files`` bounds a micro-batch. ``arrived_after`` leaves out files that were there
    before, for followers that only want new data.
    """
    stream = (
        spark.readStream.format(file_format)
        .schema(BATCH_SCHEMAS[signal])
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    if arrived_after is not None:
        stream = stream.where(F.col("_metadata.file_modification_time") >= F.lit(arrived_after))
    return stream


def follow(batches: DataFrame, signal: str, **conditions) -> DataFrame:
    """Flat rows of a stream of batches that match the lookup conditions of the signal."""
    return MATCH[signal](FLATTEN[signal](batches), **conditions)


def start(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = False
):
    """Write followed rows to Parquet, exactly once; drained and ended with ``available_now``."""
    writer = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
