"""Exports: fixed fields per signal as JSON lines, CSV or text, and filtered copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.lookups import time_between
from spanforge.schema import TIME_COLUMN

# Display names of the metric types in exports.
TYPE_NAMES = {
    "gauge": "Gauge",
    "sum": "Sum",
    "histogram": "Histogram",
    "exponential_histogram": "ExponentialHistogram",
    "summary": "Summary",
    "unknown": "Unknown",
}


def export_traces(traces: DataFrame) -> DataFrame:
    """Export rows of spans (11 fields)."""
    return traces.select(
        F.lit("trace").alias("signal"),
        T.format_timestamp_ns(F.col("start_time_unix_nano")).alias("time"),
        F.col("service_name").alias("service"),
        "span_name",
        (F.col("duration_ns").cast("double") / 1e6).alias("duration_ms"),
        "trace_id",
        "span_id",
        "parent_span_id",
        "kind",
        "status_code",
        "status_message",
    )


def export_logs(logs: DataFrame) -> DataFrame:
    """Export rows of log records (5 fields)."""
    return logs.select(
        F.lit("log").alias("signal"),
        T.format_timestamp_ns(F.col("timestamp_unix_nano")).alias("time"),
        F.col("service_name").alias("service"),
        T.severity_name(F.col("severity_number")).alias("severity"),
        "body",
    )


def export_metrics(metrics: DataFrame) -> DataFrame:
    """Export rows of metrics (7 fields), one per metric of a service with its point count."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return (
        metrics.groupBy("service_name", "metric_name", "metric_type", "unit", "description")
        .agg(
            F.count(F.when(F.col("metric_type") != "unknown", 1)).alias("data_point_count")
        )
        .select(
            F.lit("metric").alias("signal"),
            F.col("service_name").alias("service"),
            "metric_name",
            names[F.col("metric_type")].alias("type"),
            "unit",
            "description",
            "data_point_count",
        )
    )


def csv_traces(traces: DataFrame) -> DataFrame:
    """CSV columns of spans: no status message, duration with three digits."""
    return (
        export_traces(traces)
        .drop("status_message")
        .withColumn("duration_ms", T.fixed(F.col("duration_ms"), 3))
    )


csv_logs = export_logs
csv_metrics = export_metrics


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value")


def text_traces(traces: DataFrame) -> DataFrame:
    c = F.col
    return export_traces(traces).select(
        _line(
            c("time"), " ", c("service"), " ", c("span_name"), " ",
            T.fixed(c("duration_ms"), 3), "ms trace_id=", c("trace_id"),
        )
    )


def text_logs(logs: DataFrame) -> DataFrame:
    c = F.col
    return export_logs(logs).select(
        _line(c("time"), " ", c("service"), " [", c("severity"), "] ", c("body"))
    )


def text_metrics(metrics: DataFrame) -> DataFrame:
    c = F.col
    return export_metrics(metrics).select(
        _line(
            c("service"), " ", c("metric_name"), " (", c("unit"), ") [", c("type"), "] ",
            c("description"),
        )
    )


def json_lines(rows: DataFrame) -> DataFrame:
    """Export rows as JSON text, one ``value`` per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def export_all(traces: DataFrame, logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """JSON lines of all signals: traces, then logs, then metrics (``part`` keeps the order)."""
    parts = [export_traces(traces), export_logs(logs), export_metrics(metrics)]
    merged: DataFrame | None = None
    for number, rows in enumerate(parts):
        lines = json_lines(rows).withColumn("part", F.lit(number))
        merged = lines if merged is None else merged.unionByName(lines)
    return merged


def write_jsonl(rows: DataFrame, path: str, max_records: int = 0) -> None:
    """JSON lines files; ``max_records`` starts a new file after that many rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", max_records).option(
        "ignoreNullFields", "false"
    ).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def replay_selection(
    tables: dict[str, DataFrame],
    signal: str = "all",
    service: str | None = None,
    since: int | None = None,
) -> dict[str, DataFrame]:
    """The rows a replay would copy, per signal."""
    out = {}
    for name, df in tables.items():
        if signal not in ("all", name):
            continue
        if service is not None:
            df = df.where(F.col("service_name") == service)
        out[name] = time_between(df, TIME_COLUMN[name], since, None)
    return out


def replay_counts(selection: dict[str, DataFrame], batch: str | None = None) -> DataFrame:
    """Dry run: records (and batches, where a batch column is present) per signal."""
    merged: DataFrame | None = None
    for name, df in selection.items():
        batches = (
            F.count_distinct(batch) if batch and batch in df.columns else F.lit(None)
        ).cast("bigint")
        row = df.agg(F.count("*").alias("records"), batches.alias("batches")).select(
            F.lit(name).alias("signal"), "records", "batches"
        )
        merged = row if merged is None else merged.unionByName(row)
    return merged
