"""Latency percentiles, histograms and raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.numbers import exact_mean_of_counted
from spanforge.operators.ranking import pick_ranks
from spanforge.session import cut_lineage

PERCENTILES = (50, 95, 99)
DEFAULT_BUCKETS = 20


def _selected(
    traces: DataFrame, span_name: str | None, service: str | None, since: int | None
) -> DataFrame:
    if span_name is not None:
        traces = traces.where(F.col("span_name") == span_name)
    if service is not None:
        traces = traces.where(F.col("service_name") == service)
    if since is not None:
        traces = traces.where(F.col("start_time_unix_nano") >= since)
    return traces


def nearest_rank(percent: int, total: Column) -> Column:
    """0-based index of the nearest-rank percentile, halves rounded away from zero."""
    position = F.lit(percent / 100.0) * (total - 1).cast("double")
    return F.floor(position + 0.5).cast("bigint")


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often (``_n``) each duration of a key occurs, as a stored table."""
    return cut_lineage(rows.groupBy(*keys, "duration_ns").agg(F.count("*").alias("_n")))


def latency_stats(
    traces: DataFrame,
    span_name: str | None = None,
    service: str | None = None,
    since: int | None = None,
    keys: Sequence[str] = ("service_name", "span_name"),
) -> DataFrame:
    """Count, min, max, mean and nearest-rank percentiles in ms, per key.

    The percentiles are exact. They come from :func:`pick_ranks`, which never orders all
    durations of one key in one task. The spans are read once, into a table of how often each
    duration occurs; that is all the passes over digits read.
    """
    keys = list(keys)
    counted = _counted(_selected(traces, span_name, service, since), keys)

    def wanted(first: Column, end: Column, total: Column) -> Column:
        found = F.lit(False)
        for percent in PERCENTILES:
            index = nearest_rank(percent, total)
            found = found | ((index >= first) & (index < end))
        return found

    picked = pick_ranks(counted, keys, "duration_ns", wanted, weight="_n")
    ms = F.col("duration_ns").cast("double") / 1e6
    percentiles = picked.groupBy(*keys).agg(
        *[
            F.max(
                F.when(
                    (nearest_rank(p, F.col("total")) >= F.col("rank_first"))
                    & (nearest_rank(p, F.col("total")) < F.col("rank_end")),
                    ms,
                )
            ).alias(f"p{p}_ms")
            for p in PERCENTILES
        ]
    )
    totals = counted.groupBy(*keys).agg(
        F.sum("_n").alias("samples"),
        (F.min("duration_ns").cast("double") / 1e6).alias("min_ms"),
        (F.max("duration_ns").cast("double") / 1e6).alias("max_ms"),
        (exact_mean_of_counted(F.col("duration_ns"), F.col("_n")) / 1e6).alias("mean_ms"),
    )
    return totals.join(percentiles, keys)


def latency_histogram(
    traces: DataFrame,
    span_name: str | None = None,
    service: str | None = None,
    since: int | None = None,
    buckets: int = DEFAULT_BUCKETS,
    keys: Sequence[str] = ("span_name",),
) -> DataFrame:
    """Equal-width buckets between min and max duration (ms) with counts, zeros included.

    When all durations of a key are equal there is one bucket. The durations are counted per
    value first, so only distinct durations meet the bounds of their key.
    """
    keys = list(keys)
    ms = F.col("duration_ns").cast("double") / 1e6
    counted = _counted(_selected(traces, span_name, service, since), keys)
    bounds = (
        counted.groupBy(*keys)
        .agg(F.min("duration_ns").alias("_low"), F.max("duration_ns").alias("_high"))
        .withColumn("_min", F.col("_low").cast("double") / 1e6)
        .withColumn("_max", F.col("_high").cast("double") / 1e6)
        .withColumn("_width", (F.col("_max") - F.col("_min")) / F.lit(float(buckets)))
    )
    index = F.when(F.col("_width") == 0, 0).otherwise(
        F.least(
            F.floor(
                (ms - F.col("_min")) / F.when(F.col("_width") != 0, F.col("_width"))
            ).cast("int"),
            F.lit(buckets - 1),
        )
    )
    filled = (
        counted.join(bounds.select(*keys, "_min", "_width"), keys)
        .groupBy(*keys, index.alias("bucket"))
        .agg(F.sum("_n").alias("_n"))
    )
    last = F.when(F.col("_width") == 0, 0).otherwise(buckets - 1)
    grid = bounds.select(
        *keys, "_min", "_max", "_width", F.explode(F.sequence(F.lit(0), last)).alias("bucket")
    )
    low = F.col("_min") + F.col("bucket").cast("double") * F.col("_width")
    return grid.join(filled, keys + ["bucket"], "left").select(
        *keys,
        "bucket",
        low.alias("low_ms"),
        (low + F.col("_width")).alias("high_ms"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"),
    )


def latency_rows(
    traces: DataFrame,
    span_name: str | None = None,
    service: str | None = None,
    since: int | None = None,
) -> DataFrame:
    """Span name and duration in ms, fastest first (a range-partitioned sort)."""
    return (
        _selected(traces, span_name, service, since)
        .orderBy("duration_ns", "span_name")
        .select("span_name", (F.col("duration_ns").cast("double") / 1e6).alias("duration_ms"))
    )
