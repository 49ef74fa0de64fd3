"""Counts and the everyday aggregate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.numbers import exact_mean


def status(
    traces: DataFrame,
    logs: DataFrame,
    metrics: DataFrame,
    messages: DataFrame | None = None,
    sample_rate: float = 1.0,
    spans_dropped: int = 0,
    approximate: bool = False,
) -> DataFrame:
    """One row: traces, spans, logs, metric messages, data points, sampling.

    ``messages`` has one row per metric message; without it the distinct metrics are counted.
    ``approximate`` estimates the number of traces without a shuffle of their ids.
    """
    if approximate:
        span_counts = traces.agg(
            F.approx_count_distinct("trace_id", 0.01).alias("traces"),
            F.count("*").alias("spans"),
        )
    else:
        per_trace = traces.groupBy("trace_id").agg(F.count("*").alias("_n"))
        span_counts = per_trace.agg(
            F.count("*").alias("traces"), F.coalesce(F.sum("_n"), F.lit(0)).alias("spans")
        )
    counted = {
        "traces": span_counts,
        "logs": logs.agg(F.count("*").alias("logs")),
        "points": metrics.agg(
            F.count(F.when(F.col("metric_type") != "unknown", 1)).alias("data_points")
        ),
        "messages": (
            messages
            if messages is not None
            else metrics.select("service_name", "metric_name").distinct()
        ).agg(F.count("*").alias("metrics")),
    }
    names = ["traces", "spans", "logs", "metrics", "data_points"]
    merged = None
    for part in counted.values():
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(n).alias(n) for n in names]).select(
        *names,
        F.lit(float(sample_rate)).alias("sample_rate"),
        F.lit(int(spans_dropped)).cast("bigint").alias("spans_dropped"),
    )


def slowest_spans(traces: DataFrame, k: int = 20) -> DataFrame:
    """Top k spans by duration."""
    return (
        traces.orderBy(F.col("duration_ns").desc(), "trace_id", "span_id")
        .limit(k)
        .select(
            "service_name", "span_name", "trace_id", "span_id",
            (F.col("duration_ns").cast("double") / 1e6).alias("ms"),
        )
    )


def error_rate_by_service(traces: DataFrame) -> DataFrame:
    """Spans and error spans per service."""
    return traces.groupBy("service_name").agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col("status_code") == 2, 1).otherwise(0)).alias("errors"),
    )


def log_volume(logs: DataFrame) -> DataFrame:
    """Log records per severity text, most first."""
    counts = logs.groupBy("severity_text").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "severity_text")


def operation_stats(traces: DataFrame, by_service: bool = False) -> DataFrame:
    """Count, mean and maximum duration (ms) per span name, slowest first."""
    keys = ["service_name", "span_name"] if by_service else ["span_name"]
    mean = exact_mean(F.col("duration_ns")) / 1e6
    return (
        traces.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            mean.alias("avg_ms"),
            (F.max("duration_ns").cast("double") / 1e6).alias("max_ms"),
        )
        .orderBy(F.col("avg_ms").desc(), *keys)
    )


def parent_child(traces: DataFrame, k: int = 20, match_trace: bool = True) -> DataFrame:
    """Top k parent and child span names by child duration.

    Copies of a span are joined once, with their number, and multiplied out only for the rows
    shown.
    """
    ids = ["trace_id", "_id"] if match_trace else ["_id"]
    children = (
        traces.where(F.col("parent_span_id") != "")
        .withColumnRenamed("parent_span_id", "_id")
        .groupBy(*ids, F.col("span_name").alias("child"), "duration_ns")
        .agg(F.count("*").alias("_children"))
    )
    parents = (
        traces.withColumnRenamed("span_id", "_id")
        .groupBy(*ids, F.col("span_name").alias("parent"))
        .agg(F.count("*").alias("_parents"))
    )
    order = [F.col("duration_ns").desc(), "parent", "child"]
    pairs = (
        parents.join(children, ids)
        .groupBy("parent", "child", "duration_ns")
        .agg(F.sum(F.col("_children") * F.col("_parents")).alias("_times"))
    )
    shown = pairs.orderBy(*order).limit(k)
    times = F.least(F.col("_times"), F.lit(k).cast("bigint"))
    repeated = shown.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return (
        repeated.orderBy(*order, "_copy")
        .limit(k)
        .select("parent", "child", (F.col("duration_ns").cast("double") / 1e6).alias("child_ms"))
    )


def metric_by_attribute(
    metrics: DataFrame, name: str, key: str, column: str = "resource"
) -> DataFrame:
    """Sum of one metric's values per value of an attribute."""
    return (
        metrics.where(F.col("metric_name") == name)
        .groupBy(F.col(column)[key].alias("attribute"))
        .agg(F.sum("value").alias("total"))
    )
