"""Filtered lookups: one conjunction of predicates, newest first, row limit."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.schema import TIME_COLUMN

DAY_NS = 86_400 * T.NANOS


def event_date(ns: Column) -> Column:
    """Partition date of a nanosecond time, independent of the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), T.div(ns, DAY_NS).cast("int"))


def time_between(df: DataFrame, column: str, since: int | None, until: int | None) -> DataFrame:
    """Inclusive time range; on a table partitioned by ``event_date`` it prunes folders too."""
    dated = "event_date" in df.columns
    if since is not None:
        df = df.where(F.col(column) >= since)
        if dated:
            df = df.where(F.col("event_date") >= event_date(F.lit(since)))
    if until is not None:
        df = df.where(F.col(column) <= until)
        if dated:
            df = df.where(F.col("event_date") <= event_date(F.lit(until)))
    return df


def has_attributes(df: DataFrame, column: str, wanted: Mapping[str, str] | None) -> DataFrame:
    """Rows whose map holds every given key with this text."""
    for key, value in (wanted or {}).items():
        df = df.where(F.col(column)[key] == value)
    return df


def _equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def _contains(df: DataFrame, column: str, part: str | None) -> DataFrame:
    """Rows whose text contains the part, whatever the case."""
    return df if part is None else df.where(F.lower(column).contains(part.lower()))


def newest(df: DataFrame, time: str, ties: list[str], limit: int | None) -> DataFrame:
    """Newest first; with a limit Spark takes the top rows per partition, without a full sort."""
    ordered = df.orderBy(F.col(time).desc(), *ties)
    return ordered if limit is None else ordered.limit(limit)


def match_spans(
    traces: DataFrame,
    service: str | None = None,
    service_contains: str | None = None,
    span_name: str | None = None,
    trace_id: str | None = None,
    since: int | None = None,
    until: int | None = None,
    attributes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Spans matching every given condition, unordered; also for streams."""
    if trace_id is not None and not re.fullmatch(r"([0-9a-fA-F]{2})*", trace_id):
        raise ValueError(f"not a hex trace id: {trace_id!r}")
    df = _equals(
        traces,
        service_name=service,
        span_name=span_name,
        trace_id=trace_id.lower() if trace_id is not None else None,
    )
    df = _contains(df, "service_name", service_contains)
    df = time_between(df, TIME_COLUMN["traces"], since, until)
    return has_attributes(df, "attributes", attributes)


def find_spans(traces: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    """Spans matching every condition of :func:`match_spans`, newest first."""
    found = match_spans(traces, **conditions)
    return newest(found, TIME_COLUMN["traces"], ["trace_id", "span_id"], limit)


def severity_matches(mode: str, wanted: str) -> Column:
    """The three meanings of a severity filter."""
    if mode == "name_contains":
        return F.upper(T.severity_name(F.col("severity_number"))).contains(wanted.upper())
    if mode == "text_contains":
        return F.col("severity_text").contains(wanted)
    if mode == "equals":
        shown = T.severity_text(F.col("severity_number"), F.col("severity_text"))
        return F.upper(shown) == wanted.upper()
    raise ValueError(f"unknown severity mode: {mode}")


def match_logs(
    logs: DataFrame,
    service: str | None = None,
    service_contains: str | None = None,
    severity: str | None = None,
    severity_mode: str = "name_contains",
    body: str | None = None,
    since: int | None = None,
    until: int | None = None,
    attributes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Log records matching every given condition, unordered; also for streams."""
    df = _equals(logs, service_name=service)
    if severity is not None:
        df = df.where(severity_matches(severity_mode, severity))
    if body is not None:
        df = df.where(F.col("body").contains(body))
    df = _contains(df, "service_name", service_contains)
    df = time_between(df, TIME_COLUMN["logs"], since, until)
    return has_attributes(df, "attributes", attributes)


def find_logs(logs: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    """Log records matching every condition of :func:`match_logs`, newest first."""
    found = match_logs(logs, **conditions)
    return newest(found, TIME_COLUMN["logs"], ["trace_id", "span_id", "body"], limit)


def match_metrics(
    metrics: DataFrame,
    service: str | None = None,
    service_contains: str | None = None,
    name: str | None = None,
    since: int | None = None,
    until: int | None = None,
    resource: Mapping[str, str] | None = None,
) -> DataFrame:
    """Data points matching every given condition, unordered; also for streams."""
    df = _equals(metrics, service_name=service, metric_name=name)
    df = _contains(df, "service_name", service_contains)
    df = time_between(df, TIME_COLUMN["metrics"], since, until)
    return has_attributes(df, "resource", resource)


def find_metrics(metrics: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    """Data points matching every condition of :func:`match_metrics`, newest first."""
    found = match_metrics(metrics, **conditions)
    return newest(
        found, TIME_COLUMN["metrics"], ["service_name", "metric_name", "value"], limit
    )


def _any_contains(needle: str, *columns: Column) -> Column:
    found = F.lit(False)
    for column in columns:
        found = found | F.lower(column).contains(needle.lower())
    return found


def search_traces(groups: DataFrame, needle: str) -> DataFrame:
    """Trace summaries whose service, root span name or trace id contains the text."""
    return groups.where(
        _any_contains(
            needle, F.col("service_name"), F.col("root_span_name"), F.col("trace_id")
        )
    )


def search_logs(logs: DataFrame, needle: str) -> DataFrame:
    """Log records whose body, service or shown severity contains the text."""
    shown = T.severity_text(F.col("severity_number"), F.col("severity_text"))
    return logs.where(_any_contains(needle, F.col("body"), F.col("service_name"), shown))


def search_metrics(metrics: DataFrame, needle: str) -> DataFrame:
    """Data points whose metric name or service contains the text."""
    return metrics.where(_any_contains(needle, F.col("metric_name"), F.col("service_name")))


def logs_with_trace(logs: DataFrame, groups: DataFrame) -> DataFrame:
    """Every log record with the summary of its trace, NULL when there is none.

    Records without a trace id can never match. They get a made-up key each, so that they do
    not all meet in one task.
    """
    unmatched = F.concat(
        F.lit("-"), F.xxhash64("service_name", "timestamp_unix_nano", "body").cast("string")
    )
    keyed = logs.withColumn(
        "_key", F.when(F.col("trace_id") != "", F.col("trace_id")).otherwise(unmatched)
    )
    summary = groups.select(
        F.col("trace_id").alias("_key"),
        F.col("service_name").alias("root_service"),
        "root_span_name",
        "span_count",
        F.col("duration_ns").alias("trace_duration_ns"),
        "start_time_unix_nano",
    )
    return keyed.join(summary, "_key", "left").drop("_key")


def metric_catalog(metrics: DataFrame) -> DataFrame:
    """Distinct name, service, description, unit and type."""
    return metrics.select(
        "metric_name", "service_name", "description", "unit", "metric_type"
    ).distinct()
