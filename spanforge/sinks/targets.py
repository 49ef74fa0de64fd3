"""Writing to several targets, and files that rotate by size or time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from spanforge.operators.ranking import sums_before

Target = Callable[[DataFrame], None]

DEFAULT_ROTATE_BYTES = 104_857_600
DEFAULT_ROTATE_SECONDS = 3_600


def fan_out(batch: DataFrame, targets: Mapping[str, Target], batch_id: int = 0) -> DataFrame:
    """Write one batch to all targets at once; a failing or slow one does not hold up the others.

    Every target has a thread and a scheduler pool of its own, so that with fair scheduling their
    jobs share the executors. Returns one row per target: batch, target and error (NULL when it
    worked), in the order of ``targets``.
    """
    spark = batch.sparkSession
    own = not batch.is_cached  # a caller that keeps the batch keeps it
    held = batch.persist(StorageLevel.MEMORY_AND_DISK) if own else batch

    def attempt(name: str, write: Target) -> tuple[int, str, str | None]:
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"target-{name}")
            write(held)
            return batch_id, name, None
        except Exception as error:  # any failure belongs to its target alone
            return batch_id, name, str(error)

    try:
        with ThreadPoolExecutor(max_workers=max(1, len(targets))) as threads:
            running = [
                threads.submit(inheritable_thread_target(spark)(attempt), name, write)
                for name, write in targets.items()
            ]
            outcomes = [done.result() for done in running]
    finally:
        if own:
            held.unpersist()
    return spark.createDataFrame(outcomes, "batch_id bigint, target string, error string")


def records_per_file(rotate_bytes: int, bytes_per_record: int) -> int:
    """Rows per file that keep files near a size."""
    return max(1, rotate_bytes // max(1, bytes_per_record))


def rotate_interval(ns_column: str, seconds: int = DEFAULT_ROTATE_SECONDS):
    """Start (in seconds) of the rotation interval a row belongs to."""
    width = seconds * 1_000_000_000
    return (F.expr(f"{ns_column} div {width}") * seconds).alias("interval_start")


def rotation_lines(rows: DataFrame, signal: str, ns_column: str, seconds: int) -> DataFrame:
    """Rows as JSON text with the signal and the rotation interval they belong to."""
    return rows.select(
        F.lit(signal).alias("signal"),
        rotate_interval(ns_column, seconds),
        F.to_json(F.struct(*rows.columns)).alias("value"),
    )


def write_rotating(
    lines: DataFrame,
    path: str,
    rotate_bytes: int = DEFAULT_ROTATE_BYTES,
    bytes_per_record: int = 512,
) -> None:
    """Text lines (``signal``, ``interval_start``, ``value``) as files per signal and interval.

    A new interval starts new files, and within one a file closes at about ``rotate_bytes``.
    """
    lines.write.mode("append").partitionBy("signal", "interval_start").option(
        "maxRecordsPerFile", records_per_file(rotate_bytes, bytes_per_record)
    ).text(path)


def write_rotating_by_size(
    lines: DataFrame,
    path: str,
    rotate_bytes: int = DEFAULT_ROTATE_BYTES,
) -> None:
    """Text lines as files per signal and interval, closed by their real size.

    A file takes lines while those before it hold less than ``rotate_bytes`` in UTF-8 with their
    line ends, so it is never larger than that and one line. Which file a line goes to follows from
    the sum of the lines before it in its interval, ordered by their text, split over ranges; a
    task writes whole files.
    """
    keys = ["signal", "interval_start"]
    sized = lines.select(*keys, "value", (F.octet_length("value") + 1).cast("bigint").alias("_size"))
    placed = sums_before(sized, keys, ["value"], "_size", "_before")
    # div truncates a long exactly.
    numbered = placed.withColumn("file", F.expr(f"_before div {int(rotate_bytes)}"))
    whole = numbered.select(*keys, "file", "value").repartition(*keys, "file")
    whole.write.mode("append").partitionBy(*keys, "file").text(path)


def start_rotating(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    rotate_bytes: int = DEFAULT_ROTATE_BYTES,
    bytes_per_record: int = 512,
    available_now: bool = False,
):
    """The same for a stream of lines; the file sink writes every row exactly once."""
    writer = (
        lines.writeStream.format("text")
        .partitionBy("signal", "interval_start")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", records_per_file(rotate_bytes, bytes_per_record))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
