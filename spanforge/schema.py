"""Schemas: nested batches as they arrive (L0) and the three flat tables (L1)."""

from __future__ import annotations

# An attribute value is recursive, which a Spark struct cannot be: scalars keep their type and
# nested lists and maps travel as rendered JSON text in json_value.
ANY_VALUE = (
    "struct<string_value:string,bool_value:boolean,int_value:bigint,"
    "double_value:double,bytes_value:binary,json_value:string>"
)
KEY_VALUES = f"array<struct<key:string,value:{ANY_VALUE}>>"
RESOURCE = f"struct<attributes:{KEY_VALUES}>"
SCOPE = "struct<name:string,version:string>"

SPAN = (
    "struct<trace_id:binary,span_id:binary,parent_span_id:binary,name:string,kind:int,"
    "start_time_unix_nano:bigint,end_time_unix_nano:bigint,"
    f"attributes:{KEY_VALUES},"
    "events:array<struct<time_unix_nano:bigint,name:string>>,"
    "links:array<struct<trace_id:binary,span_id:binary>>,"
    "status:struct<code:int,message:string>>"
)
RESOURCE_SPANS = (
    f"resource {RESOURCE}, scope_spans array<struct<scope:{SCOPE},spans:array<{SPAN}>>>"
)

LOG_RECORD = (
    "struct<time_unix_nano:bigint,observed_time_unix_nano:bigint,severity_number:int,"
    f"severity_text:string,body:{ANY_VALUE},attributes:{KEY_VALUES},"
    "trace_id:binary,span_id:binary>"
)
RESOURCE_LOGS = (
    f"resource {RESOURCE}, "
    f"scope_logs array<struct<scope:{SCOPE},log_records:array<{LOG_RECORD}>>>"
)

NUMBER_POINT = (
    f"struct<attributes:{KEY_VALUES},time_unix_nano:bigint,as_double:double,as_int:bigint>"
)
HISTOGRAM_POINT = (
    f"struct<attributes:{KEY_VALUES},time_unix_nano:bigint,count:bigint,sum:double,"
    "bucket_counts:array<bigint>,explicit_bounds:array<double>>"
)
EXP_HISTOGRAM_POINT = (
    f"struct<attributes:{KEY_VALUES},time_unix_nano:bigint,count:bigint,sum:double>"
)
SUMMARY_POINT = (
    f"struct<attributes:{KEY_VALUES},time_unix_nano:bigint,count:bigint,sum:double,"
    "quantile_values:array<struct<quantile:double,value:double>>>"
)
METRIC = (
    "struct<name:string,description:string,unit:string,"
    f"gauge:struct<data_points:array<{NUMBER_POINT}>>,"
    f"sum:struct<data_points:array<{NUMBER_POINT}>,"
    "aggregation_temporality:int,is_monotonic:boolean>,"
    f"histogram:struct<data_points:array<{HISTOGRAM_POINT}>>,"
    f"exponential_histogram:struct<data_points:array<{EXP_HISTOGRAM_POINT}>>,"
    f"summary:struct<data_points:array<{SUMMARY_POINT}>>>"
)
RESOURCE_METRICS = (
    f"resource {RESOURCE}, scope_metrics array<struct<scope:{SCOPE},metrics:array<{METRIC}>>>"
)

TRACES = (
    "service_name string, span_name string, trace_id string, span_id string, "
    "parent_span_id string, kind int, start_time_unix_nano bigint, end_time_unix_nano bigint, "
    "duration_ns bigint, status_code int, status_message string, "
    "attributes map<string,string>, resource map<string,string>"
)
LOGS = (
    "service_name string, timestamp_unix_nano bigint, severity_number int, severity_text string, "
    "body string, trace_id string, span_id string, "
    "attributes map<string,string>, resource map<string,string>"
)
METRICS = (
    "service_name string, metric_name string, metric_type string, timestamp_unix_nano bigint, "
    "value double, unit string, attributes map<string,string>, resource map<string,string>, "
    "description string"
)


def column_names(ddl: str) -> list[str]:
    """Top-level column names of one of the flat schemas above."""
    return [part.split(" ")[0] for part in ddl.split(", ")]


TRACE_COLUMNS = column_names(TRACES)
LOG_COLUMNS = column_names(LOGS)
METRIC_COLUMNS = column_names(METRICS)

# What a saved table keeps beyond the flat one: age retention needs the observed time of logs,
# alerts need to know whether a point had a value.
SAVED_EXTRA = {
    "traces": {},
    "logs": {"observed_time_unix_nano": "bigint"},
    "metrics": {"has_value": "boolean"},
}

# Time column of each flat table.
TIME_COLUMN = {
    "traces": "start_time_unix_nano",
    "logs": "timestamp_unix_nano",
    "metrics": "timestamp_unix_nano",
}
