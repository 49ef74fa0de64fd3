import datetime as dt

from builders import (
    SECOND, dicts, log_batches, metric_batches, number_point, raw_log, raw_metric, raw_span,
    resource, span_batches, spans,
)
from pyspark.sql import functions as F

from spanforge.operators import alerts, sampling
from spanforge.sources import flatten, store
from spanforge.streaming import alerts as stream_alerts
from spanforge.streaming import follow, ingest

DAY = 86_400 * SECOND


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def span_batch(spark, seed, n=20, service="svc"):
    return span_batches(spark, (resource(service), [
        raw_span(f"op{i}", trace=bytes([seed, i] * 8), span=bytes([seed] * 8),
                 start=(seed * 100 + i) * SECOND, end=(seed * 100 + i + 2) * SECOND,
                 status={"code": 2, "message": ""} if i % 4 == 0 else None)
        for i in range(n)]))


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_follow_every_signal(spark, tmp_path):
    cases = {
        "traces": (span_batches(spark, (resource("a"), [raw_span("x"), raw_span("y")]),
                                (resource("b"), [raw_span("x")])),
                   {"service": "a", "span_name": "x"}, 1),
        "logs": (log_batches(spark, (resource("a"), [raw_log("boom", number=17), raw_log("ok")])),
                 {"severity": "error", "body": "bo"}, 1),
        "metrics": (metric_batches(spark, (resource("a", host="h"), [
            raw_metric("m", "gauge", [number_point(1), number_point(2)])])),
            {"name": "m", "resource": {"host": "h"}}, 2),
    }
    for signal, (batch, conditions, expected) in cases.items():
        base = tmp_path / signal
        land(batch, base / "in")
        rows = follow.follow(
            follow.read_batches(spark, str(base / "in"), signal), signal, **conditions)
        run(follow.start(rows, str(base / "out"), str(base / "ck"), available_now=True))
        assert spark.read.parquet(str(base / "out")).count() == expected
        land(batch, base / "in")
        run(follow.start(rows, str(base / "out"), str(base / "ck"), available_now=True))
        assert spark.read.parquet(str(base / "out")).count() == 2 * expected


def test_follow_only_new_files(spark, tmp_path):
    land(span_batch(spark, 1, 3), tmp_path / "in")
    later = dt.datetime.now() + dt.timedelta(hours=1)
    for moment, expected in ((later, 0), (later - dt.timedelta(hours=2), 3)):
        out = tmp_path / f"out{expected}"
        batches = follow.read_batches(spark, str(tmp_path / "in"), "traces",
                                      arrived_after=moment)
        run(follow.start(follow.follow(batches, "traces"), str(out),
                         str(tmp_path / f"ck{expected}"), available_now=True))
        assert spark.read.schema("span_name string").parquet(str(out)).count() == expected


def test_ingest_equals_batch(spark, tmp_path):
    batches = [span_batch(spark, s) for s in (1, 2, 3)]
    for b in batches:
        land(b, tmp_path / "in")
    root, forwarded = str(tmp_path / "root"), str(tmp_path / "fwd")

    def broken(_):
        raise RuntimeError("down")

    stream = follow.read_batches(spark, str(tmp_path / "in"), "traces", max_files=1)
    run(ingest.start_ingest(
        stream, root, "traces", str(tmp_path / "ck"), available_now=True, rate=0.4,
        targets={"copy": lambda df: df.write.mode("append").parquet(forwarded), "bad": broken}))
    flat = flatten.flatten_traces(spark.read.parquet(str(tmp_path / "in")))
    expected = sampling.sample_traces(flat, 0.4)
    saved = store.load(spark, root, "traces")
    keys = ["trace_id", "span_id", "span_name"]
    assert sorted(map(tuple, saved.select(*keys).collect())) == sorted(
        map(tuple, expected.select(*keys).collect()))
    assert flatten.flatten_traces(spark.read.parquet(forwarded)).count() == 60
    dropped = spark.read.parquet(f"{root}/_dropped/traces").agg(F.sum("spans_dropped")).first()[0]
    assert dropped == 60 - expected.count()
    outcomes = dicts(spark.read.parquet(f"{root}/_forwarded/traces"))
    assert sorted({(r["target"], r["error"]) for r in outcomes}, key=str) == [
        ("bad", "down"), ("copy", None)]
    assert len({r["batch"] for r in outcomes}) == 3


def test_retried_batch_is_idempotent(spark, tmp_path):
    step = ingest.ingest_batch(str(tmp_path), "traces")
    for batch_id in (0, 1, 1):
        step(span_batch(spark, batch_id), batch_id)
    assert store.load(spark, str(tmp_path), "traces").count() == 40


def test_stream_alerts_equal_batch(spark, tmp_path):
    rules = alerts.parse_rules(alerts.rules_frame(
        spark, ["span_duration > 1s", "error_rate > 2/1m"]))
    parts = [spans(spark, [{"start": (s * 100 + i * 7) * SECOND, "duration": 2 * SECOND,
                            "status": 2 if i % 2 else 0} for i in range(12)]) for s in range(3)]
    step = stream_alerts.alert_batch(rules, str(tmp_path), "traces")
    for batch_id, part in enumerate(parts):
        step(part, batch_id)
    step(parts[2], 2)
    got = stream_alerts.fired_alerts(spark, str(tmp_path), "traces")
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    empty = {s: spark.createDataFrame([], store.SIGNALS[s]) for s in ("logs", "metrics")}
    hits = alerts.evaluate_rules(rules, whole, empty["logs"], empty["metrics"])
    expected = alerts.alert_rows(hits)
    fields = ["rule", "kind", "at", "message"]
    assert sorted(map(tuple, got.select(*fields).collect())) == sorted(
        map(tuple, expected.select(*fields).collect()))
    assert got.count() > 3


def test_alert_state_does_not_grow_and_late_rows_count(spark, tmp_path):
    rules = alerts.parse_rules(alerts.rules_frame(spark, ["error_rate > 2/1m"]))
    step = stream_alerts.alert_batch(
        rules, str(tmp_path), "traces", cooldown_ns=SECOND, lateness_ns=300 * SECOND)
    seconds = [[0, 10], [100, 110], [], [200, 210], [25, 215], [1000, 1010], [1020]]
    for batch_id, part in enumerate(seconds):
        rows = [{"start": s * SECOND, "status": 2} for s in part]
        step(spans(spark, rows) if rows else spark.createDataFrame([], store.SIGNALS["traces"]),
             batch_id)
    base = tmp_path / "_alerts" / "traces"
    for state in ("errors", "state"):
        assert sorted(p.name for p in (base / state).glob("batch=*")) == ["batch=5", "batch=6"]
    left = spark.read.parquet(str(base / "errors" / "batch=6"))
    assert sorted(r["at"] // SECOND for r in left.collect()) == [1000, 1010, 1020]
    got = stream_alerts.fired_alerts(spark, str(tmp_path), "traces")
    assert sorted(r["at"] // SECOND for r in got.collect()) == [25, 215, 1020]


def test_alerts_run_as_a_stream(spark, tmp_path):
    for seed in (1, 2):
        land(span_batch(spark, seed), tmp_path / "in")
    rules = alerts.parse_rules(alerts.rules_frame(spark, ["span_duration > 1s"]))
    rows = follow.follow(
        follow.read_batches(spark, str(tmp_path / "in"), "traces", max_files=1), "traces")
    run(stream_alerts.start_alerts(rows, rules, str(tmp_path / "root"), "traces",
                                   str(tmp_path / "ck"), available_now=True))
    assert stream_alerts.fired_alerts(spark, str(tmp_path / "root"), "traces").count() == 2


def test_error_rate_windows_and_late_rows(spark, tmp_path):
    def write(name, seconds):
        spans(spark, [{"start": s * SECOND, "status": 2} for s in seconds]).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(store.SIGNALS["traces"]).parquet(str(tmp_path / "in"))
        windows = stream_alerts.error_rate_windows(
            rows, 2, "1 minute", "30 seconds", "10 seconds")
        run(windows.writeStream.format("parquet").outputMode("append").option(
            "path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())

    write("a", [1, 2, 3, 40])
    write("b", [400])
    write("late", [4, 5])
    write("c", [800])
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["window_start"].minute * 60 + r["window_start"].second, r["errors"])
                 for r in out.collect())
    assert (0, 4) in got
    assert all(n > 2 for _, n in got)
    assert not any(n == 6 for _, n in got)


def test_sweep(spark, tmp_path):
    root = str(tmp_path)
    rows = [{"start": d * DAY + h * SECOND, "name": f"{d}-{h}"} for d in range(4)
            for h in (10, 20)]
    store.save(spans(spark, rows), root, "traces")
    removed = ingest.sweep(spark, root, "traces", 2 * DAY + 15 * SECOND)
    assert removed == 5
    left = {r["span_name"] for r in store.load(spark, root, "traces").collect()}
    assert left == {"2-20", "3-10", "3-20"}
    assert ingest.sweep(spark, root, "traces", 2 * DAY + 15 * SECOND) == 0
    assert ingest.sweep_interval_seconds(5) == 1.0
    assert ingest.sweep_interval_seconds(300) == 30.0
    assert ingest.sweep_interval_seconds(1e6) == 60.0


def test_sweep_keeps_logs_of_fresh_observed_time(spark, tmp_path):
    root = str(tmp_path)
    batch = log_batches(spark, (resource("a"), [
        raw_log("fresh", time=0, observed=9 * DAY), raw_log("stale", time=0, observed=DAY),
        raw_log("never", time=0, observed=0), raw_log("old", time=DAY, observed=9 * DAY)]))
    ingest.ingest_batch(root, "logs")(batch, 1)
    assert ingest.sweep(spark, root, "logs", 5 * DAY) == 3
    assert [r["body"] for r in store.load(spark, root, "logs").collect()] == ["fresh"]
    assert ingest.sweep(spark, root, "logs", 10 * DAY) == 1


def test_sweep_keeps_pinned_traces(spark, tmp_path):
    root = str(tmp_path)
    store.save(spans(spark, [{"trace": "p", "name": "a"}, {"trace": "q", "name": "b"}]),
               root, "traces")
    pins = spark.createDataFrame([("p",)], "trace_id string")
    assert ingest.sweep(spark, root, "traces", DAY, pins) == 1
    assert [r["span_name"] for r in store.load(spark, root, "traces").collect()] == ["a"]


def test_saved_points_tell_missing_values(spark, tmp_path):
    root = str(tmp_path)
    bucketless = {"attributes": [], "time_unix_nano": SECOND, "count": 500, "sum": None,
                  "bucket_counts": [], "explicit_bounds": []}
    batch = metric_batches(spark, (resource("a"), [
        raw_metric("m", "gauge", [number_point(None), number_point(7)]),
        raw_metric("m", "histogram", [bucketless, {**bucketless, "sum": 9.0}])]))
    ingest.ingest_batch(root, "metrics")(batch, 1)
    saved = store.load(spark, root, "metrics")
    assert saved.count() == 4
    over = alerts.metric_over(saved, "m", ">=", 0.0)
    assert sorted(r["value"] for r in over.collect()) == [7.0, 9.0]
    hits = alerts.evaluate_rules(
        alerts.parse_rules(alerts.rules_frame(spark, ["metric m > 100"])),
        *[spark.createDataFrame([], store.SIGNALS[s]) for s in ("traces", "logs")], saved)
    assert hits.count() == 0
