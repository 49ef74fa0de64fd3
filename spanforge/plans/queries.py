"""The registered queries: one per operator, each over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import exposition as E
from spanforge.functions import text as T
from spanforge.functions.attributes import map_json, value_display
from spanforge.operators import (
    alerts, diff, intervals, latency, lookups, metrics, outliers, prometheus, retention,
    sampling, services, status, traces,
)
from spanforge.plans import fixtures as X
from spanforge.plans import sql_texts
from spanforge.sinks import export
from spanforge.sources import flatten, jsonl, store
from spanforge.sources.sql import sql
from spanforge.streaming import alerts as stream_alerts
from spanforge.streaming import follow

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the oracle.
SINCE_TRACES = X.TRACES_NOW_NS - 1_000 * X.DAY_NS
UNTIL_TRACES = X.TRACES_NOW_NS - 500 * X.DAY_NS
SINCE_LOGS = X.LOGS_NOW_NS - 10 * X.DAY_NS
LIMIT = 100
SAMPLE_RATE = 0.25
ALWAYS = ["gateway", "supplier-3"]
KEEP_PART = 20  # one trace in so many stays
NEW_PART = 100  # the newest of so many parts count as just arrived
PIN_EVERY = 1_000
KEEP_BATCHES = 20
SERIES_WIDTH = 60
THRESHOLD_PCT = 10.0
HOUR_NS = 3_600_000_000_000
SLOW_NS = 400_000_000
MAX_ERRORS = 5
RULES = [
    "span_duration > 400ms",
    "error_rate > 5/1h",
    "log_body contains 'purchase'",
    "log_severity >= ERROR",
    "metric user.error >= 100",
    "metric line.count = 6",
    "not a rule",
]


class Tables:
    """Derived tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(X, name):
            raise AttributeError(name)
        return getattr(X, name)(self.spark, self.sf_dir)

    @cached_property
    def points(self) -> DataFrame:
        return flatten.flatten_metrics(self.nested_metrics, extended=True)


_QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__doc__ = build.__doc__
    _QUERIES[build.__name__] = run
    return build


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Maps as JSON text, since results are compared by value."""
    for column in columns:
        df = df.withColumn(column, map_json(F.col(column)))
    return df


SPAN_COLUMNS = ["service_name", "span_name", "trace_id", "span_id", "duration_ns"]

# --- sources ----------------------------------------------------------------------------------


@query
def flatten_traces(t: Tables) -> DataFrame:
    """Nested batches back to the flat table, with list sizes and JSON attributes."""
    rows = flatten.flatten_traces(t.nested_traces, extended=True)
    return rows.drop("attributes", "resource")


@query
def flatten_logs(t: Tables) -> DataFrame:
    return flatten.flatten_logs(t.nested_logs, extended=True).drop("attributes", "resource")


@query
def flatten_metrics(t: Tables) -> DataFrame:
    return t.points.drop("attributes", "resource")


@query
def import_traces(t: Tables) -> DataFrame:
    lines = export.json_lines(export.export_traces(t.traces))
    return as_json(jsonl.import_traces(lines), "attributes", "resource")


@query
def import_logs(t: Tables) -> DataFrame:
    lines = export.json_lines(export.export_logs(t.logs))
    return as_json(jsonl.import_logs(lines), "attributes", "resource")


@query
def import_metrics(t: Tables) -> DataFrame:
    lines = export.json_lines(export.export_metrics(t.metrics))
    return as_json(jsonl.import_metrics(lines), "attributes", "resource")


@query
def detect_signal(t: Tables) -> DataFrame:
    """Signal and format of the landing files the tables would be delivered in."""
    named = {
        ("spans-", ".jsonl"): (t.traces, "start_time_unix_nano"),
        ("app-log-", ".ndjson"): (t.logs, "timestamp_unix_nano"),
        ("metrics-", ".pb"): (t.metrics, "timestamp_unix_nano"),
    }
    files = None
    for (prefix, extension), (df, time) in named.items():
        day = T.div(F.col(time), X.DAY_NS).cast("string")
        path = F.concat(
            F.lit("/landing/"), F.lit(prefix), "service_name", F.lit("-"), day, F.lit(extension)
        )
        part = df.select(path.alias("path")).distinct()
        files = part if files is None else files.unionByName(part)
    path = F.col("path")
    return files.select(
        "path",
        jsonl.detect_signal(path).alias("signal"),
        jsonl.detect_format(path).alias("format"),
    )


@query
def multi_source(t: Tables) -> DataFrame:
    columns = [*SPAN_COLUMNS, "resource"]
    merged = store.union_sources(
        {
            "http://edge:4317": t.root_spans.select(*columns),
            "backend:4317": t.child_spans.select(*columns),
        }
    )
    return merged.select(*SPAN_COLUMNS, F.col("resource")["source"].alias("source"))


# --- sinks ------------------------------------------------------------------------------------


@query
def export_traces(t: Tables) -> DataFrame:
    return export.export_traces(t.traces)


@query
def export_csv(t: Tables) -> DataFrame:
    return export.csv_traces(t.traces)


@query
def export_logs(t: Tables) -> DataFrame:
    return export.export_logs(t.logs)


@query
def export_metrics(t: Tables) -> DataFrame:
    return export.export_metrics(t.metrics)


@query
def export_text(t: Tables) -> DataFrame:
    return (
        export.text_traces(t.traces)
        .unionByName(export.text_logs(t.logs))
        .unionByName(export.text_metrics(t.metrics))
    )


@query
def export_all(t: Tables) -> DataFrame:
    """Every signal as JSON lines; the compared fields are read back from the line."""
    lines = export.export_all(t.traces, t.logs, t.metrics)
    fields = ["signal", "time", "service", "span_name", "body", "metric_name"]
    return lines.select("part", F.json_tuple("value", *fields).alias(*fields))


@query
def replay_counts(t: Tables) -> DataFrame:
    tables = {"traces": t.traces, "logs": t.log_records, "metrics": t.metrics}
    chosen = export.replay_selection(tables, since=SINCE_TRACES)
    return export.replay_counts(chosen, batch="batch_id")


@query
def prometheus_samples(t: Tables) -> DataFrame:
    return prometheus.prometheus_samples(t.nested_metrics).select(
        "metric", "sample_name", "labels", "value", "value_text", "timestamp_unix_nano", "position"
    )


@query
def prometheus_text(t: Tables) -> DataFrame:
    counts = status.status(t.traces, t.logs, t.metrics)
    lines = prometheus.prometheus_lines(t.nested_metrics, counts)
    return prometheus.in_exposition_order(lines).select("block", "section", "metric", "line")


# --- lookups ----------------------------------------------------------------------------------


@query
def find_spans(t: Tables) -> DataFrame:
    found = lookups.find_spans(
        t.traces, service="supplier-3", since=SINCE_TRACES, until=UNTIL_TRACES,
        attributes={"flag": "R"},
    )
    return as_json(found, "attributes", "resource")


@query
def find_spans_newest(t: Tables) -> DataFrame:
    found = lookups.find_spans(t.traces, span_name="line.AF", limit=LIMIT)
    return found.select(*SPAN_COLUMNS, "start_time_unix_nano")


@query
def find_logs(t: Tables) -> DataFrame:
    found = lookups.find_logs(
        t.logs, service="user-svc-1", severity="info", body="signup", since=SINCE_LOGS,
        attributes={"type": "signup"},
    )
    return as_json(found, "attributes", "resource")


@query
def find_logs_by_severity(t: Tables) -> DataFrame:
    """The three severity filters side by side."""
    wanted = {"name_contains": "inf", "text_contains": "WAR", "equals": "info"}
    out = None
    for mode, severity in wanted.items():
        found = lookups.find_logs(t.logs, severity=severity, severity_mode=mode)
        part = found.select(
            F.lit(mode).alias("mode"), "service_name", "timestamp_unix_nano", "body"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def find_metrics(t: Tables) -> DataFrame:
    found = lookups.find_metrics(
        t.metrics, service="user-svc-2", name="user.view", since=SINCE_LOGS
    )
    return as_json(found, "attributes", "resource")


@query
def find_metrics_by_resource(t: Tables) -> DataFrame:
    found = lookups.find_metrics(t.metrics, resource={"service.name": "supplier-4"})
    return found.select("metric_name", "metric_type", "timestamp_unix_nano", "value")


@query
def search_traces(t: Tables) -> DataFrame:
    return lookups.search_traces(traces.trace_groups(t.traces), "urgent")


@query
def search_logs(t: Tables) -> DataFrame:
    found = lookups.search_logs(t.logs, "Warn")
    return found.select("service_name", "timestamp_unix_nano", "severity_text", "body")


@query
def search_metrics(t: Tables) -> DataFrame:
    found = lookups.search_metrics(t.metrics, "LINE.")
    return found.select("service_name", "metric_name", "timestamp_unix_nano", "value")


@query
def logs_with_trace(t: Tables) -> DataFrame:
    joined = lookups.logs_with_trace(t.logs, traces.trace_groups(t.traces))
    return joined.drop("attributes", "resource")


@query
def logs_in_spans(t: Tables) -> DataFrame:
    """Log records moved to around the time of their trace, with the spans they fall in."""
    roots = t.traces.where(F.col("parent_span_id") == "").select(
        "trace_id",
        F.col("start_time_unix_nano").alias("begun"),
        (2 * F.col("duration_ns") + 1).alias("reach"),
    )
    moved = t.logs.join(roots, "trace_id").withColumn(
        "timestamp_unix_nano", F.col("begun") + F.pmod("timestamp_unix_nano", "reach")
    )
    return intervals.logs_in_spans(moved, t.traces)


@query
def follow_traces(t: Tables) -> DataFrame:
    """What a follower of landing batches gets, on all that has landed."""
    found = follow.follow(t.nested_traces, "traces", service="supplier-5", span_name="line.RF")
    return as_json(found, "attributes", "resource")


@query
def follow_logs(t: Tables) -> DataFrame:
    found = follow.follow(t.nested_logs, "logs", severity="error", body="error")
    return as_json(found, "attributes", "resource")


@query
def follow_metrics(t: Tables) -> DataFrame:
    found = follow.follow(t.nested_metrics, "metrics", service="supplier-2", name="line.count")
    return as_json(found, "attributes", "resource")


@query
def metric_catalog(t: Tables) -> DataFrame:
    return lookups.metric_catalog(t.metrics)


# --- analyses ---------------------------------------------------------------------------------


@query
def trace_groups(t: Tables) -> DataFrame:
    return traces.in_group_order(traces.trace_groups(t.traces))


@query
def span_tree(t: Tables) -> DataFrame:
    ids = ["trace_id", "span_id", "parent_span_id"]
    tree = traces.in_tree_order(traces.span_tree(t.traces.select(*ids, "start_time_unix_nano")))
    return tree.select(*ids, "depth", "position", "subtree_size", "orphan")


@query
def waterfall_layout(t: Tables) -> DataFrame:
    return traces.waterfall_layout(t.traces).select(
        "trace_id", "span_id", "left_pct", "width_pct"
    )


@query
def display_rows(t: Tables) -> DataFrame:
    return traces.display_rows(flatten.flatten_traces(t.nested_traces, extended=True)).drop(
        "duration"
    )


@query
def service_map(t: Tables) -> DataFrame:
    return services.in_call_order(services.service_map(t.traces))


@query
def service_map_since(t: Tables) -> DataFrame:
    return services.in_call_order(services.service_map(t.traces, since=SINCE_TRACES))


@query
def service_map_by_span_id(t: Tables) -> DataFrame:
    """Edges matched on the span id alone, as some senders need."""
    return services.in_call_order(services.service_map(t.traces, match_trace=False))


@query
def service_map_mermaid(t: Tables) -> DataFrame:
    lines = services.mermaid_lines(services.service_map(t.traces))
    return services.in_line_order(lines).select("section", "line")


@query
def service_map_text(t: Tables) -> DataFrame:
    lines = services.text_lines(services.service_map(t.traces))
    return services.in_line_order(lines).select("section", "line")


@query
def latency_stats(t: Tables) -> DataFrame:
    return latency.latency_stats(t.traces)


@query
def latency_histogram(t: Tables) -> DataFrame:
    return latency.latency_histogram(t.traces)


@query
def latency_rows(t: Tables) -> DataFrame:
    return latency.latency_rows(t.traces, service="supplier-1")


@query
def outlier_spans(t: Tables) -> DataFrame:
    return outliers.outlier_spans(t.traces).select(*SPAN_COLUMNS)


@query
def outlier_traces(t: Tables) -> DataFrame:
    return outliers.outlier_traces(t.traces)


@query
def tagged_spans(t: Tables) -> DataFrame:
    return outliers.tagged_spans(t.traces).select(*SPAN_COLUMNS, "tag")


@query
def trace_diff(t: Tables) -> DataFrame:
    return diff.in_diff_order(diff.trace_diff(t.traces, t.trace_pair, THRESHOLD_PCT))


@query
def trace_diff_summary(t: Tables) -> DataFrame:
    return diff.trace_diff_summary(t.traces, t.trace_pair, THRESHOLD_PCT)


@query
def trace_diff_pairs(t: Tables) -> DataFrame:
    return diff.trace_diff(t.traces, t.trace_pairs, THRESHOLD_PCT)


@query
def trace_diff_pairs_summary(t: Tables) -> DataFrame:
    return diff.trace_diff_summary(t.traces, t.trace_pairs, THRESHOLD_PCT)


@query
def metric_rollup(t: Tables) -> DataFrame:
    return metrics.metric_rollup(t.points).select(
        "metric_name", "service_name", "metric_type", "unit", "description", "point_count",
        "newest_unix_nano", "newest_value", F.round("total", 3).alias("total"), "all_int",
    )


@query
def metric_display(t: Tables) -> DataFrame:
    shown = metrics.with_display_value(metrics.metric_rollup(t.points))
    return shown.select(
        "metric_name",
        "service_name",
        (F.col("display_value") == "-").alias("is_empty"),
        F.round("display_number", 3).alias("display_number"),
    )


@query
def metric_series(t: Tables) -> DataFrame:
    return metrics.metric_series(t.metrics, SERIES_WIDTH)


@query
def table_status(t: Tables) -> DataFrame:
    messages = flatten.metric_messages(t.nested_metrics)
    return status.status(t.traces, t.logs, t.metrics, messages)


_QUERIES["status"] = _QUERIES.pop("table_status")


@query
def slowest_spans(t: Tables) -> DataFrame:
    return status.slowest_spans(t.traces)


@query
def error_rate_by_service(t: Tables) -> DataFrame:
    return status.error_rate_by_service(t.traces)


@query
def log_volume(t: Tables) -> DataFrame:
    return status.log_volume(t.logs)


@query
def operation_stats(t: Tables) -> DataFrame:
    return status.operation_stats(t.traces)


@query
def operation_stats_by_service(t: Tables) -> DataFrame:
    return status.operation_stats(t.traces, by_service=True)


@query
def parent_child(t: Tables) -> DataFrame:
    return status.parent_child(t.traces)


@query
def metric_by_attr(t: Tables) -> DataFrame:
    return status.metric_by_attribute(t.metrics, "line.count", "service.name")


# --- sampling and retention -------------------------------------------------------------------


@query
def sample_traces(t: Tables) -> DataFrame:
    return sampling.sample_traces(t.traces, SAMPLE_RATE).select(*SPAN_COLUMNS)


@query
def sample_always(t: Tables) -> DataFrame:
    return sampling.sample_traces(t.traces, SAMPLE_RATE, ALWAYS).select(*SPAN_COLUMNS)


@query
def sample_report(t: Tables) -> DataFrame:
    return sampling.sample_report(t.traces, SAMPLE_RATE, ALWAYS)


@query
def retain_traces(t: Tables) -> DataFrame:
    pins = t.root_spans.where(F.col("ingest_seq") % PIN_EVERY == 0).select("trace_id")
    keep = t.root_spans.agg(F.expr(f"count(*) div {KEEP_PART}")).scalar()
    new_from = t.root_spans.agg(F.expr(f"max(ingest_seq) - max(ingest_seq) div {NEW_PART}")).scalar()
    kept = retention.retain_traces(t.spans, keep, pins, new_from=new_from)
    return kept.select(*SPAN_COLUMNS)


@query
def retain_logs(t: Tables) -> DataFrame:
    kept = retention.retain_batches(t.log_records, KEEP_BATCHES)
    return kept.select("batch_id", "service_name", "timestamp_unix_nano", "body")


@query
def retain_metrics(t: Tables) -> DataFrame:
    """Points of every kind, in batches by day."""
    days = t.metric_points.withColumn("batch_id", T.div(F.col("timestamp_unix_nano"), X.DAY_NS))
    kept = retention.retain_batches(days, KEEP_BATCHES)
    return kept.select("batch_id", "service_name", "metric_name", "timestamp_unix_nano")


@query
def retain_by_age_traces(t: Tables) -> DataFrame:
    return retention.retain_spans_by_age(t.traces, SINCE_TRACES).select(*SPAN_COLUMNS)


@query
def retain_by_age_logs(t: Tables) -> DataFrame:
    kept = retention.retain_logs_by_age(t.logs, SINCE_LOGS)
    return kept.select("service_name", "timestamp_unix_nano", "body")


@query
def retain_by_age_metrics(t: Tables) -> DataFrame:
    """On nested batches: old points leave, then metrics and batches left empty."""
    kept = retention.retain_nested_metrics_by_age(t.nested_metrics, SINCE_LOGS)
    return flatten.flatten_metrics(kept).select(
        "service_name", "metric_name", "timestamp_unix_nano", "value"
    )


# --- alerts -----------------------------------------------------------------------------------


@query
def alert_span_duration(t: Tables) -> DataFrame:
    return alerts.slow_spans(t.traces, SLOW_NS).select(*SPAN_COLUMNS)


@query
def alert_error_rate(t: Tables) -> DataFrame:
    failed = t.traces.where(F.col("status_code") == 2)
    at = F.col("start_time_unix_nano").alias("at")
    return alerts.error_bursts(failed.select(at), MAX_ERRORS, HOUR_NS)


@query
def error_rate_windows(t: Tables) -> DataFrame:
    """The streaming form on a table: an hour every half hour."""
    found = stream_alerts.error_rate_windows(t.traces, MAX_ERRORS, "1 hour", "30 minutes", "1 hour")
    return found.select(
        (F.unix_micros("window_start") * 1000).alias("window_start_ns"),
        (F.unix_micros("window_end") * 1000).alias("window_end_ns"),
        "errors",
    )


@query
def alert_log_body(t: Tables) -> DataFrame:
    found = alerts.logs_containing(t.logs, "purchase")
    return found.select("service_name", "timestamp_unix_nano", "body")


@query
def alert_log_severity(t: Tables) -> DataFrame:
    found = alerts.logs_at_least(t.logs, "WARN")
    return found.select("service_name", "timestamp_unix_nano", "severity_number", "body")


@query
def alert_metric(t: Tables) -> DataFrame:
    found = alerts.metric_over(t.metrics, "user.error", ">", 100.0)
    return found.select("service_name", "metric_name", "timestamp_unix_nano", "value")


@query
def alert_cooldown(t: Tables) -> DataFrame:
    """Every severity as a rule of its own, silent for an hour after a fire."""
    rule = F.concat(F.lit("severity "), F.col("severity_number").cast("string"))
    hits = t.logs.select(rule.alias("rule"), F.col("timestamp_unix_nano").alias("at"))
    return alerts.cooldown(hits, HOUR_NS)


def _hits(t: Tables) -> DataFrame:
    rules = alerts.parse_rules(alerts.rules_frame(t.spark, RULES))
    return alerts.evaluate_rules(rules, t.traces, t.logs, t.metrics)


@query
def alert_rules(t: Tables) -> DataFrame:
    return _hits(t).select("rule", "kind", "at")


@query
def alerts_all(t: Tables) -> DataFrame:
    return alerts.alert_rows(_hits(t), X.DAY_NS).select("rule", "kind", "at")


@query
def alert_messages(t: Tables) -> DataFrame:
    """Fired alerts with their message text."""
    return alerts.alert_rows(_hits(t), X.DAY_NS)


# --- scalar functions -------------------------------------------------------------------------


@query
def attribute_display(t: Tables) -> DataFrame:
    """A value of every type, as shown beside its key."""
    c = F.col
    inner = F.struct((c("kind") / 8.0).alias("eighth"), (c("status_code") == 2).alias("failed"))
    nested = F.to_json(F.struct(c("span_name").alias("name"), F.array(inner, inner).alias("each")))
    typed = {
        "name": {"string_value": c("span_name")},
        "kind": {"int_value": c("kind").cast("bigint")},
        "eighth": {"double_value": c("kind") / 8.0},
        "failed": {"bool_value": c("status_code") == 2},
        "id": {"bytes_value": F.unhex("span_id")},
        "list": {"json_value": F.to_json(F.array(c("span_name"), c("kind").cast("string")))},
        "map": {"json_value": nested},
        "unset": {},
    }
    kinds = {
        "string_value": "string", "bool_value": "boolean", "int_value": "bigint",
        "double_value": "double", "bytes_value": "binary", "json_value": "string",
    }
    pairs = [
        F.struct(
            F.lit(key).alias("key"),
            F.struct(*[given.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()]).alias("value"),
        )
        for key, given in typed.items()
    ]
    shown = t.traces.select("span_id", F.explode(F.array(*pairs)).alias("a"))
    return shown.select("span_id", "a.key", value_display(c("a.value")).alias("shown"))


@query
def scalar_functions(t: Tables) -> DataFrame:
    """Display functions over spans; numbers are compared before they become text."""
    c = F.col
    start, length = c("start_time_unix_nano"), c("duration_ns")
    price = length.cast("double") / 7.0
    return t.traces.select(
        "span_id",
        T.format_timestamp_ns(start).alias("ts_text"),
        T.format_time_of_day(start).alias("time_of_day"),
        T.format_timestamp_full(start).alias("full_time"),
        T.duration_scaled(length).alias("duration_number"),
        T.duration_unit(length).alias("duration_unit"),
        T.severity_text(c("kind") * 5, c("status_message")).alias("severity"),
        T.severity_name(c("kind") * 5).alias("severity_enum"),
        T.severity_number(c("span_name")).alias("severity_guess"),
        T.span_kind_name(c("kind")).alias("kind_name"),
        T.status_name(c("status_code") + 1).alias("status_text"),
        T.compact_scaled(price).alias("compact_number"),
        T.compact_suffix(price).alias("compact_suffix"),
        E.metric_name(c("span_name")).alias("clean_name"),
        T.short_id(c("trace_id")).alias("short_id"),
    )


# --- SQL --------------------------------------------------------------------------------------


def _sql_query(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        store.register(spark, {"traces": t.traces, "logs": t.logs, "metrics": t.metrics})
        return sql(spark, text)

    run.__doc__ = f"SQL text {name} over the registered tables."
    _QUERIES[name] = run


for _name, _text in sql_texts.SPARK.items():
    _sql_query(_name, _text)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
