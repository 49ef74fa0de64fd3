"""Spans much slower than the others of their operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DEVIATIONS = 2.0
OPERATION = ["service_name", "span_name"]


def with_outlier_flag(traces: DataFrame, deviations: float = DEFAULT_DEVIATIONS) -> DataFrame:
    """All spans with ``is_outlier``: duration above mean + k population deviations.

    The statistics are an aggregate joined back, not a window per operation: a hot operation
    is combined map-side, and Spark splits its rows over tasks when the join is not broadcast.
    """
    limits = traces.groupBy(*OPERATION).agg(
        F.count("*").alias("_n"),
        F.min("duration_ns").alias("_low"),
        F.max("duration_ns").alias("_high"),
        (
            F.avg(F.col("duration_ns").cast("double"))
            + F.lit(deviations) * F.stddev_pop(F.col("duration_ns").cast("double"))
        ).alias("_cutoff"),
    )
    meaningful = (F.col("_n") >= 2) & (F.col("_low") < F.col("_high"))
    limits = limits.select(*OPERATION, F.when(meaningful, F.col("_cutoff")).alias("_cutoff"))
    flag = F.coalesce(F.col("duration_ns").cast("double") > F.col("_cutoff"), F.lit(False))
    return traces.join(limits, OPERATION).withColumn("is_outlier", flag).drop("_cutoff")


def outlier_spans(traces: DataFrame, deviations: float = DEFAULT_DEVIATIONS) -> DataFrame:
    return with_outlier_flag(traces, deviations).where("is_outlier").drop("is_outlier")


def outlier_traces(traces: DataFrame, deviations: float = DEFAULT_DEVIATIONS) -> DataFrame:
    """Trace ids with at least one outlier span, and how many they have."""
    return (
        outlier_spans(traces, deviations)
        .groupBy("trace_id")
        .agg(F.count("*").alias("outlier_spans"))
    )


def tagged_spans(traces: DataFrame, deviations: float = DEFAULT_DEVIATIONS) -> DataFrame:
    """All spans with the listing tag ``[SLOW]`` on outliers."""
    tag = F.when(F.col("is_outlier"), "[SLOW]").otherwise("")
    return with_outlier_flag(traces, deviations).withColumn("tag", tag).drop("is_outlier")
