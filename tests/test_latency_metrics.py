import random

from builders import (
    MS, SECOND, dicts, metric_batches, number_point, points, raw_metric, resource, spans,
)
from test_flatten import histogram

from spanforge.operators import latency, metrics, prometheus, status
from spanforge.sources import flatten


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(11)
    groups = {"hot": 401, "one": 1, "two": 2}
    rows, expected = [], {}
    for name, n in groups.items():
        values = [rng.choice([5, rng.randrange(1 << 44), rng.randrange(1 << 30)])
                  for _ in range(n)]
        rows += [{"name": name, "duration": v} for v in values]
        ordered = sorted(values)
        expected[name] = [ordered[int(p / 100 * (n - 1) + 0.5)] / 1e6 for p in (50, 95, 99)]
    got = {r["span_name"]: r for r in dicts(latency.latency_stats(spans(spark, rows)))}
    for name, values in expected.items():
        assert [got[name][f"p{p}_ms"] for p in (50, 95, 99)] == values
        assert got[name]["samples"] == groups[name]


def test_single_value_and_no_rows(spark):
    df = spans(spark, [{"name": "x", "duration": 42 * MS}])
    row = dicts(latency.latency_stats(df, span_name="x"))[0]
    assert (row["p50_ms"], row["p99_ms"], row["mean_ms"]) == (42.0, 42.0, 42.0)
    assert latency.latency_stats(df, span_name="absent").count() == 0


def test_histogram(spark):
    df = spans(spark, [{"name": "x", "duration": d * MS} for d in range(1, 11)]
               + [{"name": "same", "duration": MS}] * 3
               + [{"name": "gap", "duration": d} for d in (0, 100)])
    got = {}
    for r in dicts(latency.latency_histogram(df, buckets=5).orderBy("bucket")):
        got.setdefault(r["span_name"], []).append(r["count"])
    assert got == {"x": [2, 2, 2, 2, 2], "same": [3], "gap": [1, 0, 0, 0, 1]}


def test_latency_rows(spark):
    df = spans(spark, [{"duration": 3 * MS}, {"duration": MS}])
    assert [r["duration_ms"] for r in dicts(latency.latency_rows(df))] == [1.0, 3.0]


def rolled(spark, *batch):
    df = flatten.flatten_metrics(metric_batches(spark, (resource(), list(batch))), True)
    return {r["metric_name"]: r for r in
            dicts(metrics.with_display_value(metrics.metric_rollup(df)))}


def test_display_values(spark):
    got = rolled(
        spark,
        raw_metric("ints", "sum", [number_point(3), number_point(4, 2 * SECOND)]),
        raw_metric("mixed", "gauge", [number_point(1.5), number_point(2, 2 * SECOND)]),
        raw_metric("one", "gauge", [number_point(2.25)]),
        raw_metric("hist", "histogram", [histogram(10, 123.5), {**histogram(4, None),
                                                              "time_unix_nano": 2 * SECOND}]),
        raw_metric("none"),
    )
    assert got["ints"]["display_value"] == "7"
    assert got["mixed"]["display_value"] == "3.500000"
    assert got["one"]["display_value"] == "2.250000"
    assert got["hist"]["display_value"] == "count=4 sum=0.000"
    assert got["none"]["display_value"] == "-"
    assert got["none"]["point_count"] == 0


def test_rollup_takes_newest_type_and_oldest_unit(spark):
    got = rolled(
        spark,
        raw_metric("m", "sum", [number_point(1, 5 * SECOND)], unit="new", description="later"),
        raw_metric("m", "gauge", [number_point(1.0, SECOND)], unit="old", description="first"),
    )["m"]
    assert (got["metric_type"], got["unit"], got["description"]) == ("sum", "old", "first")


def test_series_picks_match_indexing(spark):
    rng = random.Random(2)
    rows, width = {}, 7
    for name, n in {"big": 53, "exact": 7, "small": 5, "tiny": 4}.items():
        rows[name] = [(rng.randrange(20) * SECOND, float(rng.randrange(100))) for _ in range(n)]
    df = points(spark, [{"name": k, "time": t, "value": v} for k, vs in rows.items()
                        for t, v in vs])
    got = {}
    for r in dicts(metrics.metric_series(df, width).orderBy("metric_name", "position")):
        got.setdefault(r["metric_name"], []).append((r["position"], r["value"], r["normalized"]))
    assert "tiny" not in got
    for name in ("big", "exact", "small"):
        ordered = sorted(rows[name])
        n = len(ordered)
        index = range(n) if n <= width else [i * (n - 1) // (width - 1) for i in range(width)]
        values = [ordered[i][1] for i in index]
        low, high = min(v for _, v in ordered), max(v for _, v in ordered)
        assert got[name] == [(i, v, (v - low) / max(high - low, 0.001))
                             for i, v in enumerate(values)]


def test_prometheus_histogram_and_headers(spark):
    batch = metric_batches(spark, (resource("svc"), [
        raw_metric("lat.ms", "histogram", [histogram(10, 123.5, (10.0, 50.0), (2, 3, 5))],
                   description="how\nlong"),
        raw_metric("hits", "sum", [number_point(3, attributes={"a.b": 'x"y', "n": 1.5})]),
        raw_metric("level", "sum", [number_point(2)], is_monotonic=False),
        raw_metric("none", description=""),
    ]))
    text = [r["line"] for r in
            prometheus.in_exposition_order(prometheus.prometheus_lines(batch)).collect()]
    assert text == [
        "# HELP hits test metric", "# TYPE hits counter",
        'hits{service_name="svc",a_b="x\\"y",n="1.5"} 3',
        "# HELP lat_ms how\\nlong", "# TYPE lat_ms histogram",
        'lat_ms_bucket{service_name="svc",le="10"} 2',
        'lat_ms_bucket{service_name="svc",le="50"} 5',
        'lat_ms_bucket{service_name="svc",le="+Inf"} 10',
        'lat_ms_sum{service_name="svc"} 123.5', 'lat_ms_count{service_name="svc"} 10',
        "# HELP level test metric", "# TYPE level gauge", 'level{service_name="svc"} 2',
        "# TYPE none untyped",
    ]


def test_prometheus_without_labels(spark):
    batch = metric_batches(spark, (resource(None), [raw_metric("g", "gauge", [number_point(1)])]))
    assert dicts(prometheus.prometheus_samples(batch))[0]["labels"] == ""


def test_status(spark):
    t = spans(spark, [{"trace": "a"}, {"trace": "a"}, {"trace": "b"}])
    p = points(spark, [{"value": 1.0}, {"value": 2.0}, {"type": "unknown", "name": "n"}])
    row = dicts(status.status(t, spark.createDataFrame([], "x int"), p))[0]
    assert (row["traces"], row["spans"], row["logs"], row["metrics"], row["data_points"]) == (
        2, 3, 0, 2, 2)


def test_sums_beyond_a_long(spark):
    big = 1 << 62
    df = spans(spark, [{"name": "x", "duration": big, "start": 0, "trace": str(i)}
                       for i in range(4)])
    assert dicts(status.operation_stats(df))[0]["avg_ms"] == big / 1e6
    assert dicts(latency.latency_stats(df))[0]["mean_ms"] == big / 1e6


def test_approximate_status(spark):
    t = spans(spark, [{"trace": "a"}, {"trace": "b"}])
    none = spark.createDataFrame([], "x int")
    row = dicts(status.status(t, none, points(spark, [{}]), approximate=True))[0]
    assert (row["traces"], row["spans"]) == (2, 2)


def test_parent_child_multiplies_copies(spark):
    rows = [{"span": "p", "name": "P"}, {"span": "c", "parent": "p", "name": "C", "duration": 5}]
    df = spans(spark, rows * 2 + [{"span": "d", "parent": "p", "name": "D", "duration": 4}])
    got = [(r["parent"], r["child"]) for r in dicts(status.parent_child(df, k=5))]
    assert got == [("P", "C")] * 4 + [("P", "D")]


def test_latency_reads_the_spans_once(spark, tmp_path):
    """Passes over digits read a table of counted durations; weights stand for the rows."""
    rows = [{"span": str(i), "service": "s", "name": "n", "duration": (i % 7) * MS} for i in range(50)]
    spans(spark, rows).write.parquet(str(tmp_path / "spans"))
    df = spark.read.parquet(str(tmp_path / "spans"))
    for found in (latency.latency_stats(df), latency.latency_histogram(df)):
        assert found.inputFiles() and all("/cut-" in f for f in found.inputFiles())
    (row,) = dicts(latency.latency_stats(df))
    assert (row["samples"], row["min_ms"], row["max_ms"], row["p50_ms"], row["p99_ms"]) == (50, 0.0, 6.0, 3.0, 6.0)
    assert row["mean_ms"] == sum(i % 7 for i in range(50)) / 50
