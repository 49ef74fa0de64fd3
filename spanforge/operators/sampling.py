"""Deterministic sampling of whole traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampling_position(trace_id: Column) -> Column:
    """A number in [0, 1) that depends on the trace id only."""
    head = F.conv(F.substring(F.md5(trace_id), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def is_kept(rate: float, always: Sequence[str] = ()) -> Column:
    """Whether a span survives: its trace is in the sample or its service is always kept."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"sample rate must lie between 0 and 1: {rate}")
    if rate >= 1.0:
        return F.lit(True)
    kept = F.lit(False) if rate <= 0.0 else sampling_position(F.col("trace_id")) < rate
    if always:
        kept = kept | F.col("service_name").isin(*always)
    return kept


def sample_traces(traces: DataFrame, rate: float, always: Sequence[str] = ()) -> DataFrame:
    """Spans of sampled traces; a filter, so it runs inside the scan stage."""
    return traces.where(is_kept(rate, always))


def sample_report(traces: DataFrame, rate: float, always: Sequence[str] = ()) -> DataFrame:
    """Spans kept and dropped per service."""
    kept = is_kept(rate, always)
    return traces.groupBy("service_name").agg(
        F.sum(F.when(kept, 1).otherwise(0)).alias("spans_kept"),
        F.sum(F.when(kept, 0).otherwise(1)).alias("spans_dropped"),
    )
