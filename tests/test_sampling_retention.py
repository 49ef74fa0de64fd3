import random
import re

import pytest
from builders import (
    SECOND, dicts, log_batches, metric_batches, number_point, points, raw_log, raw_metric,
    raw_span, resource, span_batches, spans,
)
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.operators import retention, sampling
from spanforge.sources import flatten


def many(spark, n=400):
    return spans(spark, [{"trace": f"{i:032x}", "span": f"{i}-{j}", "service": f"s{i % 3}"}
                         for i in range(n) for j in range(2)])


def test_sampling_rates(spark):
    df = many(spark)
    assert sampling.sample_traces(df, 0.0).count() == 0
    assert sampling.sample_traces(df, 1.0).count() == 800
    kept = sampling.sample_traces(df, 0.5)
    per_trace = kept.groupBy("trace_id").count()
    assert per_trace.where("count <> 2").count() == 0
    assert 140 < per_trace.count() < 260
    smaller = sampling.sample_traces(df, 0.2).select("trace_id").distinct()
    assert smaller.join(kept, "trace_id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_traces(df, 1.5)


def test_always_kept_services_and_report(spark):
    df = many(spark)
    only = sampling.sample_traces(df, 0.0, ["s1"])
    assert {r["service_name"] for r in only.collect()} == {"s1"}
    report = {r["service_name"]: (r["spans_kept"], r["spans_dropped"])
              for r in dicts(sampling.sample_report(df, 0.0, ["s1"]))}
    assert report == {"s0": (0, 268), "s1": (266, 0), "s2": (0, 266)}


def arrivals(spark, order, spans_each=2):
    rows = [(t, seq, j) for seq, t in enumerate(order) for j in range(spans_each)]
    return spark.createDataFrame(rows, "trace_id string, ingest_seq bigint, j int")


def kept_ids(df):
    return {r["trace_id"] for r in df.select("trace_id").distinct().collect()}


def pins(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "trace_id string")


def test_retain_newest_traces(spark):
    df = arrivals(spark, "abcdef")
    assert kept_ids(retention.retain_traces(df, 2)) == {"e", "f"}
    assert kept_ids(retention.retain_traces(df, 9)) == set("abcdef")
    assert retention.retain_traces(df, 2).count() == 4
    assert kept_ids(retention.retain_traces(df, 0)) == set()


def test_retain_pins_and_new(spark):
    df = arrivals(spark, "abcdef")
    assert kept_ids(retention.retain_traces(df, 2, pins(spark, "a"))) == {"a", "f"}
    assert kept_ids(retention.retain_traces(df, 1, pins(spark, "a", "b"))) == {"a", "b"}
    assert kept_ids(retention.retain_traces(df, 1, new_from=4)) == {"e", "f"}
    assert kept_ids(retention.retain_traces(df, 4, pins(spark, "a"), new_from=5)) == set("adef")


def test_first_arrival_counts_not_the_latest(spark):
    df = arrivals(spark, "abcda")
    assert kept_ids(retention.retain_traces(df, 3)) == {"b", "c", "d"}


def test_retain_against_brute_force(spark):
    rng = random.Random(4)
    order = [f"t{rng.randrange(60)}" for _ in range(200)]
    df = arrivals(spark, order, 1)
    first = {}
    for seq, t in enumerate(order):
        first.setdefault(t, seq)
    pinned = sorted(first)[:5]
    for keep in (0, 4, 20, 500):
        safe = {t for t in first if t in pinned or first[t] >= 150}
        rest = sorted((t for t in first if t not in safe), key=lambda t: -first[t])
        expected = safe | set(rest[: max(0, keep - len(safe))])
        assert kept_ids(retention.retain_traces(df, keep, pins(spark, *pinned), new_from=150)) \
            == expected


def test_spans_are_filtered_under_the_windows_they_come_from(spark):
    order = [f"t{i}" for i in range(40)]
    rows = [(t, i, 0) for i, t in enumerate(order)]
    # Late spans of an old trace and of a pinned one, and spans whose arrival is not known.
    rows += [("t1", 99, 1), ("t2", 99, 1), ("t39", None, 1), ("t2", None, 2), ("t3", None, 1)]
    df = spark.createDataFrame(rows, "trace_id string, ingest_seq bigint, j int")
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy("j"))
    kept = retention.retain_traces(df.withColumn("n", n), 4, pins(spark, "t2"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Window \[|LeftSemi", plan) == ["Window [", "LeftSemi"] * 2
    ids = {"t2", "t37", "t38", "t39"}
    assert sorted((r["trace_id"], r["j"], r["n"]) for r in kept.collect()) == sorted(
        (t, j, j + 1) for t, _, j in rows if t in ids)


def test_retain_batches(spark):
    df = spark.createDataFrame([(b, i) for b in (3, 1, 2, 9) for i in range(3)],
                               "batch_id int, i int")
    assert {r[0] for r in retention.retain_batches(df, 2).select("batch_id").collect()} == {3, 9}
    assert retention.retain_batches(df, 10).count() == 12
    assert retention.retain_batches(df, 0).count() == 0


def test_pins(spark):
    held = pins(spark, "a", "b")
    assert kept_ids(retention.add_pins(held, pins(spark, "b", "c"))) == {"a", "b", "c"}
    assert kept_ids(retention.remove_pins(held, pins(spark, "b"))) == {"a"}
    assert kept_ids(retention.toggle_pins(held, pins(spark, "b", "c"))) == {"a", "c"}


def test_age_of_spans_and_pins(spark):
    df = spans(spark, [{"trace": "old", "start": 0, "duration": 5},
                       {"trace": "edge", "start": 0, "duration": 10},
                       {"trace": "edge", "start": 0, "duration": 9}])
    assert retention.retain_spans_by_age(df, 10).count() == 1
    assert retention.retain_spans_by_age(df, 10, pins(spark, "old")).count() == 2


def test_age_on_nested_batches(spark):
    t = span_batches(spark, (resource(), [raw_span(end=5), raw_span(end=50)]),
                     (resource(), [raw_span(end=6)]))
    kept = retention.retain_nested_traces_by_age(t, 10)
    assert kept.count() == 1 and flatten.flatten_traces(kept).count() == 1
    lg = log_batches(spark, (resource(), [raw_log("a", time=0, observed=20),
                                          raw_log("b", time=5, observed=20)]))
    logs = flatten.flatten_logs(retention.retain_nested_logs_by_age(lg, 10))
    assert [r["body"] for r in logs.collect()] == ["a"]
    flat = flatten.flatten_logs(lg, extended=True)
    assert [r["body"] for r in retention.retain_logs_by_age(flat, 10).collect()] == ["a"]
    m = metric_batches(
        spark,
        (resource(), [raw_metric("g", "gauge", [number_point(1, 5), number_point(2, 50)]),
                      raw_metric("s", "sum", [number_point(3, 5)]), raw_metric("none")]),
        (resource(), [raw_metric("none")]))
    kept = retention.retain_nested_metrics_by_age(m, 10)
    assert kept.schema == m.schema or kept.columns == m.columns
    assert [(r["metric_name"], r["value"]) for r in flatten.flatten_metrics(kept).collect()] == [
        ("g", 2.0)]
    assert kept.count() == 1


def test_age_of_flat_metrics(spark):
    df = points(spark, [{"time": 5}, {"time": SECOND}, {"type": "unknown", "time": SECOND}])
    assert retention.retain_metrics_by_age(df, 10).count() == 1
    assert df.where(F.col("metric_type") == "unknown").count() == 1
