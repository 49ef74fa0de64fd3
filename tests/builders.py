"""Small hand-made telemetry for tests."""

from __future__ import annotations

from spanforge import schema

MS = 1_000_000
SECOND = 1_000_000_000


def value(v):
    out = dict.fromkeys(
        ["string_value", "bool_value", "int_value", "double_value", "bytes_value", "json_value"]
    )
    if isinstance(v, bool):
        out["bool_value"] = v
    elif isinstance(v, int):
        out["int_value"] = v
    elif isinstance(v, float):
        out["double_value"] = v
    elif isinstance(v, bytes):
        out["bytes_value"] = v
    elif isinstance(v, dict):
        out["json_value"] = v["json"]
    elif v is not None:
        out["string_value"] = v
    return out


def kvs(pairs):
    items = pairs.items() if isinstance(pairs, dict) else pairs
    return [{"key": k, "value": value(v)} for k, v in items]


def resource(service="test-service", **more):
    pairs = {} if service is None else {"service.name": service}
    return {"attributes": kvs({**pairs, **more})}


def raw_span(name="s", trace=b"\x01" * 16, span=b"\x01\x02\x03\x04\x05\x06\x07\x08", parent=b"",
             start=SECOND, end=2 * SECOND, status=None, attributes=(), **more):
    return {
        "trace_id": bytearray(trace), "span_id": bytearray(span),
        "parent_span_id": bytearray(parent), "name": name, "kind": 1,
        "start_time_unix_nano": start, "end_time_unix_nano": end, "attributes": kvs(attributes),
        "events": more.get("events", []), "links": more.get("links", []), "status": status,
    }


def span_batches(spark, *batches):
    rows = [(res, [{"scope": None, "spans": spans}]) for res, spans in batches]
    return spark.createDataFrame(rows, schema.RESOURCE_SPANS)


def raw_log(body="hello", time=SECOND, observed=SECOND, number=9, text="INFO", attributes=(),
            trace=b"", span=b""):
    return {
        "time_unix_nano": time, "observed_time_unix_nano": observed, "severity_number": number,
        "severity_text": text, "body": value(body), "attributes": kvs(attributes),
        "trace_id": bytearray(trace), "span_id": bytearray(span),
    }


def log_batches(spark, *batches):
    rows = [(res, [{"scope": {"name": "sc", "version": "1"}, "log_records": recs}])
            for res, recs in batches]
    return spark.createDataFrame(rows, schema.RESOURCE_LOGS)


def number_point(v, time=SECOND, attributes=()):
    return {
        "attributes": kvs(attributes), "time_unix_nano": time,
        "as_double": v if isinstance(v, float) else None,
        "as_int": v if isinstance(v, int) else None,
    }


def raw_metric(name, kind=None, points=(), unit="1", description="test metric", **data):
    out = {"name": name, "description": description, "unit": unit, "gauge": None, "sum": None,
           "histogram": None, "exponential_histogram": None, "summary": None}
    if kind is not None:
        out[kind] = {"data_points": list(points), **data}
        if kind == "sum":
            out[kind].setdefault("aggregation_temporality", 2)
            out[kind].setdefault("is_monotonic", True)
    return out


def metric_batches(spark, *batches):
    rows = [(res, [{"scope": None, "metrics": metrics}]) for res, metrics in batches]
    return spark.createDataFrame(rows, schema.RESOURCE_METRICS)


def spans(spark, rows):
    """Flat spans from dicts with defaults."""
    full = []
    for i, r in enumerate(rows):
        start = r.get("start", SECOND)
        length = r.get("duration", MS)
        service = r.get("service", "svc")
        full.append((
            service, r.get("name", "op"), r.get("trace", "t1"), r.get("span", f"{i:04d}"),
            r.get("parent", ""), r.get("kind", 1), start, start + length, length,
            r.get("status", 0), r.get("message", ""), r.get("attributes", {}),
            {"service.name": service},
        ))
    return spark.createDataFrame(full, schema.TRACES)


def logs(spark, rows):
    full = [
        (r.get("service", "svc"), r.get("time", SECOND), r.get("number", 9), r.get("text", ""),
         r.get("body", "hello"), r.get("trace", ""), r.get("span", ""),
         r.get("attributes", {}), {"service.name": r.get("service", "svc")})
        for r in rows
    ]
    return spark.createDataFrame(full, schema.LOGS)


def points(spark, rows):
    full = [
        (r.get("service", "svc"), r.get("name", "m"), r.get("type", "gauge"),
         r.get("time", SECOND), r.get("value"), r.get("unit", "1"), {},
         {"service.name": r.get("service", "svc")}, r.get("description", "d"))
        for r in rows
    ]
    return spark.createDataFrame(full, schema.METRICS)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
