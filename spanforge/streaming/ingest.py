"""Streaming ingest: forward everything, sample, append; and the retention sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import retention, sampling
from spanforge.operators.lookups import event_date
from spanforge.session import cut_lineage
from spanforge.sinks.targets import Target, fan_out
from spanforge.sources import store
from spanforge.streaming.follow import FLATTEN


def ingest_batch(
    root: str,
    signal: str,
    rate: float = 1.0,
    always: Sequence[str] = (),
    targets: Mapping[str, Target] | None = None,
):
    """The ``foreachBatch`` function of one signal.

    Order: forward the batch to every target, then sample (traces only), then append. The
    appended rows, the drop counts and the forwarding outcomes belong to the batch id, so a
    batch that is retried replaces itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            if targets:
                outcome = fan_out(held, targets, batch_id)
                outcome.write.mode("overwrite").parquet(
                    f"{root}/_forwarded/{signal}/batch={batch_id}"
                )
            rows = FLATTEN[signal](held, extended=True)
            if signal == "traces" and rate < 1.0:
                sampling.sample_report(rows, rate, always).write.mode("overwrite").parquet(
                    f"{root}/_dropped/{signal}/batch={batch_id}"
                )
                rows = sampling.sample_traces(rows, rate, always)
            store.save(rows, root, signal, batch_id)
        finally:
            held.unpersist()

    return run


def start_ingest(
    batches: DataFrame,
    root: str,
    signal: str,
    checkpoint: str,
    available_now: bool = False,
    **options,
):
    """Run :func:`ingest_batch` over a stream of nested batches."""
    writer = batches.writeStream.foreachBatch(ingest_batch(root, signal, **options)).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def sweep_interval_seconds(max_age_seconds: float) -> float:
    """How often to sweep: a tenth of the age, at least 1 s and at most 60 s."""
    return min(60.0, max(1.0, max_age_seconds / 10))


_KEEP = {
    "traces": retention.retain_spans_by_age,
    "logs": retention.retain_logs_by_age,
    "metrics": retention.retain_metrics_by_age,
}


def sweep(
    spark: SparkSession, root: str, signal: str, cutoff: int, pins: DataFrame | None = None
) -> int:
    """Remove rows older than the cutoff from a saved signal; returns how many.

    Only date folders up to the cutoff's date are looked at: those that still hold rows are
    rewritten, those without any are removed, and newer ones are not touched. ``pins`` (a frame
    of ``trace_id``) keeps pinned traces whatever their age.
    """
    if pins is not None and signal != "traces":
        raise ValueError(f"pins hold traces, not {signal}")
    table = store.load(spark, root, signal)
    old = table.where(F.col("event_date") <= event_date(F.lit(cutoff)))
    options = {} if pins is None else {"pins": pins}
    kept = cut_lineage(_KEEP[signal](old, cutoff, **options))
    parts = ["batch", "event_date"]
    before = old.groupBy(*parts).agg(F.count("*").alias("n"))
    after = kept.groupBy(*parts).agg(F.count("*").alias("left"))
    # One row per old date folder, never the rows themselves.
    changed = [
        row
        for row in before.join(after, parts, "left").collect()
        if row["n"] != (row["left"] or 0)
    ]
    touched = [r for r in changed if r["left"]]
    if touched:
        marks = spark.createDataFrame(
            [(r["batch"], r["event_date"]) for r in touched], "batch bigint, event_date date"
        )
        kept.join(F.broadcast(marks), parts, "left_semi").hint("rebalance", *parts).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(
            f"{root.rstrip('/')}/{signal}"
        )
    for row in changed:
        if not row["left"]:
            _remove(spark, f"{root.rstrip('/')}/{signal}", row["batch"], row["event_date"])
    return sum(r["n"] - (r["left"] or 0) for r in changed)


def _remove(spark: SparkSession, folder: str, batch: int, date) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch}/event_date={date}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
