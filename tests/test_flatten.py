import json
import os

import pytest
from builders import (
    SECOND, dicts, log_batches, metric_batches, number_point, raw_log, raw_metric, raw_span,
    resource, span_batches,
)
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import attributes as A
from spanforge.sources import flatten


def test_span_fields_and_defaults(spark):
    batches = span_batches(
        spark,
        (resource("svc", region="eu"), [
            raw_span("alpha", status={"code": 2, "message": "boom"}),
            raw_span("beta", start=5 * SECOND, end=4 * SECOND),
        ]),
        (resource(None), [raw_span("gamma", parent=b"\xff" * 8)]),
    )
    rows = {r["span_name"]: r for r in dicts(flatten.flatten_traces(batches))}
    assert list(flatten.flatten_traces(batches).columns) == schema.TRACE_COLUMNS
    assert rows["alpha"]["trace_id"] == "01" * 16
    assert rows["alpha"]["span_id"] == "0102030405060708"
    assert rows["alpha"]["parent_span_id"] == ""
    assert rows["alpha"]["duration_ns"] == SECOND
    assert (rows["alpha"]["status_code"], rows["alpha"]["status_message"]) == (2, "boom")
    assert rows["alpha"]["resource"] == {"service.name": "svc", "region": "eu"}
    assert rows["beta"]["duration_ns"] == 0
    assert (rows["beta"]["status_code"], rows["beta"]["status_message"]) == (0, "")
    assert rows["gamma"]["service_name"] == ""
    assert rows["gamma"]["parent_span_id"] == "ff" * 8


def test_unsigned_times_saturate(spark):
    wide = spark.createDataFrame([("18446744073709551615",), ("5",)], "t string").select(
        F.col("t").cast("decimal(20,0)").alias("t")
    )
    got = [r[0] for r in wide.select(flatten.saturated(F.col("t"))).collect()]
    assert got == [9_223_372_036_854_775_807, 5]
    wrapped = spark.createDataFrame([(-1,)], "t bigint").select(flatten.saturated(F.col("t")))
    assert wrapped.first()[0] == 9_223_372_036_854_775_807


def test_attribute_values(spark):
    pairs = [("s", 'q"x'), ("b", True), ("i", 7), ("d", 1.5), ("y", b"\x0a\xff"),
             ("j", {"json": "[1,2]"}), ("n", None), ("s", "last")]
    batch = span_batches(spark, (resource(), [raw_span(attributes=pairs)]))
    row = dicts(flatten.flatten_traces(batch, extended=True))[0]
    assert row["attributes"] == {"s": "last", "b": "true", "i": "7", "d": "1.5", "y": "0aff",
                                 "j": "[1,2]", "n": None}
    assert row["attributes_json"] == (
        '{"b":true,"d":1.5,"i":7,"j":[1,2],"n":null,"s":"last","y":"0aff"}')
    shown = batch.select(F.explode("scope_spans").alias("s")).select(
        F.explode(F.col("s.spans")[0]["attributes"]).alias("kv")
    ).select("kv.key", A.value_display(F.col("kv.value")).alias("v"))
    assert [r["v"] for r in shown.collect()] == [
        'q"x', "true", "7", "1.500000", "0aff", "[1, 2]", "", "last"]


def test_nested_values_are_shown_member_by_member(spark):
    long = "x\\n" * 50_000
    cases = {
        "[]": "[]", "{}": "{}", "[1,2.5,-3e2,true,null]": "[1, 2.500000, -300.000000, true, ]",
        '{"a":{"b":[1,{"c":"d"}]},"e":"f"}': "{a={b=[1, {c=d}]}, e=f}",
        '["[x, y]", "q\\"{:}", "\\u00e9\\\\", "1.5"]': '[[x, y], q"{:}, é\\, 1.5]',
        f'["{long}"]': "[" + "x\n" * 50_000 + "]", "[" * 400 + "]" * 400: "[" * 400 + "]" * 400,
        '"alone"': "alone", "[1,": "[1,", "no json": "no json", "12345678901234567890": "12345678901234567890",
    }
    got = spark.createDataFrame(list(cases.items()), "j string, want string").select(
        "j", "want", A.json_display(F.col("j")).alias("got"))
    for row in got.collect():
        assert row["got"] == row["want"], row["j"][:80]
    assert spark.range(1).select(A.json_display(F.lit(None).cast("string"))).first()[0] is None


def test_service_name_must_be_text(spark):
    batch = span_batches(spark, ({"attributes": [{"key": "service.name", "value": {
        "string_value": None, "bool_value": None, "int_value": 5, "double_value": None,
        "bytes_value": None, "json_value": None}}]}, [raw_span()]))
    assert dicts(flatten.flatten_traces(batch))[0]["service_name"] == ""


def test_event_and_link_counts(spark):
    span = raw_span(events=[{"time_unix_nano": 1, "name": "e"}] * 3,
                    links=[{"trace_id": bytearray(b"a"), "span_id": bytearray(b"b")}])
    row = dicts(flatten.flatten_traces(span_batches(spark, (resource(), [span])), True))[0]
    assert (row["events_count"], row["links_count"]) == (3, 1)


def test_logs(spark):
    batch = log_batches(spark, (resource(), [
        raw_log("one"), raw_log(42, time=0, observed=7, number=0, text="")]))
    rows = {r["body"]: r for r in dicts(flatten.flatten_logs(batch, True))}
    assert rows["one"]["timestamp_unix_nano"] == SECOND
    assert rows["42"]["timestamp_unix_nano"] == 0
    assert rows["42"]["observed_time_unix_nano"] == 7
    assert rows["42"]["severity_text"] == ""
    assert rows["one"]["scope_name"] == "sc"


def histogram(count, total, bounds=(), counts=()):
    return {"attributes": [], "time_unix_nano": SECOND, "count": count, "sum": total,
            "bucket_counts": list(counts), "explicit_bounds": list(bounds)}


def test_metrics_of_every_kind(spark):
    exp = {"attributes": [], "time_unix_nano": SECOND, "count": 4, "sum": None}
    summary = {"attributes": [], "time_unix_nano": SECOND, "count": 2, "sum": 9.0,
               "quantile_values": [{"quantile": 0.5, "value": 4.0}]}
    missing = {"attributes": [], "time_unix_nano": SECOND, "as_double": None, "as_int": None}
    batch = metric_batches(spark, (resource(), [
        raw_metric("g", "gauge", [number_point(1.5), missing]),
        raw_metric("s", "sum", [number_point(3)]),
        raw_metric("h", "histogram", [histogram(10, 123.5), histogram(7, None)]),
        raw_metric("e", "exponential_histogram", [exp]),
        raw_metric("q", "summary", [summary]),
        raw_metric("none"),
        raw_metric("empty", "gauge", []),
    ]))
    rows = [(r["metric_name"], r["metric_type"], r["timestamp_unix_nano"], r["value"])
            for r in dicts(flatten.flatten_metrics(batch))]
    assert sorted(rows, key=str) == sorted([
        ("g", "gauge", SECOND, 1.5), ("g", "gauge", SECOND, 0.0), ("s", "sum", SECOND, 3.0),
        ("h", "histogram", SECOND, 123.5), ("h", "histogram", SECOND, 7.0),
        ("e", "exponential_histogram", SECOND, 4.0), ("q", "summary", SECOND, 9.0),
        ("none", "unknown", 0, None)], key=str)
    flags = {(r["metric_name"], r["value"]): (r["is_int"], r["has_value"])
             for r in dicts(flatten.flatten_metrics(batch, True))}
    assert flags[("g", 0.0)] == (False, False)
    assert flags[("s", 3.0)] == (True, True)
    assert flags[("h", 7.0)] == (False, False)


def test_nested_traces_do_not_shuffle_whole_spans(spark):
    from spanforge.plans import fixtures

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test data is not here")
    nested = fixtures.nested_traces(spark, "/root/testdata/sf0.001")
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(trace_id" not in plan


def test_json_text_with_something_to_escape(spark):
    texts = ["plain", 'a"b', "a\\b", "a\nb\x01", "é x", "", "tab\t"]
    batch = (resource(), [raw_span(attributes=[(f"k{i}{t}", t) for i, t in enumerate(texts)])])
    row = flatten.flatten_traces(span_batches(spark, batch), extended=True).first()
    assert json.loads(row["attributes_json"]) == {f"k{i}{t}": t for i, t in enumerate(texts)}
