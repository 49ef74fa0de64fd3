"""Nested batches to flat tables: one pass over the input, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import attributes as A
from spanforge.functions.numbers import MAX_LONG


def saturated(ns: Column) -> Column:
    """An unsigned 64-bit time as bigint; values beyond the range become its maximum.

    Readers deliver such values as decimal(20,0); negative bigints are wrapped ones.
    """
    return F.when((ns < 0) | (ns > MAX_LONG), F.lit(MAX_LONG)).otherwise(ns.cast("bigint"))


def _with_resource(batches: DataFrame, scopes: str) -> DataFrame:
    pairs = F.col("pairs")
    return batches.select(
        F.col("resource.attributes").alias("pairs"), F.explode(scopes).alias("scope")
    ).select(
        A.service_name(pairs).alias("service_name"),
        A.to_map(pairs).alias("resource"),
        A.to_json_object(pairs).alias("resource_json"),
        "scope",
    )


def flatten_traces(batches: DataFrame, extended: bool = False) -> DataFrame:
    """``resource_spans`` batches to the ``traces`` table.

    ``extended`` adds typed JSON text of both attribute lists and the event and link counts.
    """
    rows = (
        _with_resource(batches, "scope_spans")
        .select(
            "service_name", "resource", "resource_json", F.explode("scope.spans").alias("span")
        )
        .withColumn("start", saturated(F.coalesce(F.col("span.start_time_unix_nano"), F.lit(0))))
        .withColumn("end", saturated(F.coalesce(F.col("span.end_time_unix_nano"), F.lit(0))))
    )

    def ident(name: str) -> Column:
        return F.coalesce(A.bytes_hex(F.col(f"span.{name}")), F.lit("")).alias(name)

    columns = [
        F.col("service_name"),
        F.coalesce(F.col("span.name"), F.lit("")).alias("span_name"),
        ident("trace_id"),
        ident("span_id"),
        ident("parent_span_id"),
        F.coalesce(F.col("span.kind"), F.lit(0)).alias("kind"),
        F.col("start").alias("start_time_unix_nano"),
        F.col("end").alias("end_time_unix_nano"),
        F.greatest(F.col("end") - F.col("start"), F.lit(0)).cast("bigint").alias("duration_ns"),
        F.coalesce(F.col("span.status.code"), F.lit(0)).alias("status_code"),
        F.coalesce(F.col("span.status.message"), F.lit("")).alias("status_message"),
        A.to_map(F.col("span.attributes")).alias("attributes"),
        F.col("resource"),
    ]
    if extended:
        columns += [
            A.to_json_object(F.col("span.attributes")).alias("attributes_json"),
            F.col("resource_json"),
            F.coalesce(F.size("span.events"), F.lit(0)).alias("events_count"),
            F.coalesce(F.size("span.links"), F.lit(0)).alias("links_count"),
        ]
    return rows.select(*columns)


def flatten_logs(batches: DataFrame, extended: bool = False) -> DataFrame:
    """``resource_logs`` batches to the ``logs`` table (``time_unix_nano`` only).

    ``extended`` adds JSON text, the observed time and the scope name.
    """
    rows = _with_resource(batches, "scope_logs").select(
        "service_name",
        "resource",
        "resource_json",
        F.col("scope.scope.name").alias("scope_name"),
        F.explode("scope.log_records").alias("record"),
    )

    def ident(name: str) -> Column:
        return F.coalesce(A.bytes_hex(F.col(f"record.{name}")), F.lit("")).alias(name)

    time = F.coalesce(F.col("record.time_unix_nano"), F.lit(0))
    columns = [
        F.col("service_name"),
        saturated(time).alias("timestamp_unix_nano"),
        F.coalesce(F.col("record.severity_number"), F.lit(0)).alias("severity_number"),
        F.coalesce(F.col("record.severity_text"), F.lit("")).alias("severity_text"),
        F.coalesce(A.value_text(F.col("record.body")), F.lit("")).alias("body"),
        ident("trace_id"),
        ident("span_id"),
        A.to_map(F.col("record.attributes")).alias("attributes"),
        F.col("resource"),
    ]
    if extended:
        columns += [
            A.to_json_object(F.col("record.attributes")).alias("attributes_json"),
            F.col("resource_json"),
            saturated(
                F.coalesce(F.col("record.observed_time_unix_nano"), F.lit(0))
            ).alias("observed_time_unix_nano"),
            F.coalesce(F.col("scope_name"), F.lit("")).alias("scope_name"),
        ]
    return rows.select(*columns)


# Data point of any kind, so that one explode covers all of them.
_POINT = (
    f"array<struct<kind:string,time:bigint,value:double,is_int:boolean,has_value:boolean,"
    f"count:bigint,sum:double,attributes:{schema.KEY_VALUES}>>"
)


def _any_points(metric: Column, kind: str, label: str) -> Column:
    points = metric[kind]["data_points"]
    null = F.lit(None)

    def number(dp: Column) -> Column:
        value = F.coalesce(dp["as_double"], dp["as_int"].cast("double"))
        return F.struct(
            F.lit(label).alias("kind"),
            dp["time_unix_nano"].alias("time"),
            F.coalesce(value, F.lit(0.0)).alias("value"),
            (dp["as_double"].isNull() & dp["as_int"].isNotNull()).alias("is_int"),
            value.isNotNull().alias("has_value"),
            null.cast("bigint").alias("count"),
            null.cast("double").alias("sum"),
            dp["attributes"].alias("attributes"),
        )

    def distribution(dp: Column) -> Column:
        count = dp["count"].cast("double")
        value = dp["sum"] if kind == "summary" else F.coalesce(dp["sum"], count)
        return F.struct(
            F.lit(label).alias("kind"),
            dp["time_unix_nano"].alias("time"),
            F.coalesce(value, F.lit(0.0)).alias("value"),
            F.lit(False).alias("is_int"),
            dp["sum"].isNotNull().alias("has_value"),
            dp["count"].alias("count"),
            dp["sum"].alias("sum"),
            dp["attributes"].alias("attributes"),
        )

    each = number if kind in ("gauge", "sum") else distribution
    return F.coalesce(F.transform(points, each).cast(_POINT), F.expr(f"cast(array() as {_POINT})"))


KINDS = {
    "gauge": "gauge",
    "sum": "sum",
    "histogram": "histogram",
    "exponential_histogram": "exponential_histogram",
    "summary": "summary",
}


def metric_messages(batches: DataFrame) -> DataFrame:
    """One row per metric message, with its resource columns."""
    return _with_resource(batches, "scope_metrics").select(
        "service_name",
        "resource",
        "resource_json",
        F.explode("scope.metrics").alias("metric"),
    )


def flatten_metrics(batches: DataFrame, extended: bool = False) -> DataFrame:
    """``resource_metrics`` batches to the ``metrics`` table, one row per data point.

    A metric without data yields one row of type ``unknown`` with a NULL value. ``extended``
    adds JSON text, the point's count and sum, and whether it was an integer or had a value.
    """
    metric = F.col("metric")
    no_data = F.lit(True)
    for kind in KINDS:
        no_data = no_data & metric[kind].isNull()
    null = F.lit(None)
    placeholder = F.array(
        F.struct(
            F.lit("unknown").alias("kind"),
            F.lit(0).cast("bigint").alias("time"),
            null.cast("double").alias("value"),
            F.lit(False).alias("is_int"),
            F.lit(False).alias("has_value"),
            null.cast("bigint").alias("count"),
            null.cast("double").alias("sum"),
            F.lit(None).cast(schema.KEY_VALUES).alias("attributes"),
        )
    ).cast(_POINT)
    points = F.when(no_data, placeholder).otherwise(
        F.concat(*[_any_points(metric, kind, label) for kind, label in KINDS.items()])
    )
    rows = metric_messages(batches).select(
        "service_name",
        "resource",
        "resource_json",
        F.coalesce(F.col("metric.name"), F.lit("")).alias("metric_name"),
        F.coalesce(F.col("metric.unit"), F.lit("")).alias("unit"),
        F.coalesce(F.col("metric.description"), F.lit("")).alias("description"),
        F.explode(points).alias("dp"),
    )
    columns = [
        F.col("service_name"),
        F.col("metric_name"),
        F.col("dp.kind").alias("metric_type"),
        saturated(F.coalesce(F.col("dp.time"), F.lit(0))).alias("timestamp_unix_nano"),
        F.col("dp.value").alias("value"),
        F.col("unit"),
        A.to_map(F.col("dp.attributes")).alias("attributes"),
        F.col("resource"),
        F.col("description"),
    ]
    if extended:
        columns += [
            A.to_json_object(F.col("dp.attributes")).alias("attributes_json"),
            F.col("resource_json"),
            F.col("dp.count").alias("point_count"),
            F.col("dp.sum").alias("point_sum"),
            F.col("dp.is_int").alias("is_int"),
            F.col("dp.has_value").alias("has_value"),
        ]
    return rows.select(*columns)
