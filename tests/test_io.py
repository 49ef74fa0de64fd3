import re
import json

import pytest
from builders import MS, SECOND, dicts, logs, points, spans
from pyspark.sql import functions as F

from spanforge.sinks import export, targets
from spanforge.sources import jsonl, store


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_import_traces(spark):
    text = json.dumps({"time": "2024-01-01T00:00:00.123456789Z", "service": "a",
                       "span_name": "op", "duration_ms": 1.5, "trace_id": "AB", "span_id": "cd",
                       "status": "Error"})
    full, bare = dicts(jsonl.import_traces(lines(spark, text, "", "{}")).orderBy("service_name"))
    assert full["start_time_unix_nano"] == 1_704_067_200_123_456_789
    assert full["duration_ns"] == 1_500_000
    assert full["end_time_unix_nano"] - full["start_time_unix_nano"] == 1_500_000
    assert (full["trace_id"], full["status_code"]) == ("ab", 2)
    assert bare["service_name"] == "unknown"
    assert (bare["trace_id"], bare["span_id"]) == ("0" * 32, "0" * 16)
    assert (bare["start_time_unix_nano"], bare["status_code"]) == (0, 0)


def test_bad_json_fails_with_its_line(spark):
    with pytest.raises(Exception, match="invalid JSON line: not json"):
        jsonl.import_traces(lines(spark, "{}", "not json")).collect()


def test_bad_time_fails(spark):
    with pytest.raises(Exception):
        jsonl.import_logs(lines(spark, '{"time": "yesterday"}')).collect()


def test_import_logs_and_metrics(spark):
    got = dicts(jsonl.import_logs(lines(
        spark, '{"severity": "SEVERITY_NUMBER_WARN", "body": "b", '
               '"time": "1970-01-01T01:00:01+01:00"}')))[0]
    assert (got["severity_number"], got["timestamp_unix_nano"]) == (13, SECOND)
    metric = dicts(jsonl.import_metrics(lines(
        spark, '{"name": "m", "unit": "s"}', '{"metric_name": "n", "value": 2.5}'))
        .orderBy("metric_name"))
    assert [(m["metric_name"], m["value"], m["unit"]) for m in metric] == [
        ("m", None, "s"), ("n", 2.5, "")]


def test_detection(spark):
    paths = ["/a/traces.jsonl", "/a/app-logs.json", "/logs/my_metrics.pb", "/x/catalog.ndjson",
             "/y/spans.bin", "/z/plain", "/z/dir.log/data"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", jsonl.detect_signal(F.col("p")), jsonl.detect_format(F.col("p")))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {
        "/a/traces.jsonl": ("traces", "jsonl"), "/a/app-logs.json": ("logs", "jsonl"),
        "/logs/my_metrics.pb": ("metrics", "protobuf"), "/x/catalog.ndjson": ("logs", "jsonl"),
        "/y/spans.bin": ("traces", "protobuf"), "/z/plain": ("traces", "jsonl"),
        "/z/dir.log/data": ("traces", "jsonl")}


def small(spark):
    t = spans(spark, [{"name": "a", "duration": 1234 * 1000, "status": 2, "message": "m"},
                      {"name": "b", "start": 2 * SECOND}])
    lg = logs(spark, [{"body": 'say "hi"', "number": 17}])
    p = points(spark, [{"value": 1.0}, {"value": 2.0}, {"name": "n", "type": "unknown"}])
    return t, lg, p


def test_exports(spark, tmp_path):
    t, lg, p = small(spark)
    export.write_jsonl(export.export_traces(t), str(tmp_path / "j"))
    rows = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(rows) == 2 and len(rows[0]) == 11
    assert {r["span_name"]: r["duration_ms"] for r in rows} == {"a": 1.234, "b": 1.0}
    export.write_csv(export.csv_traces(t), str(tmp_path / "c"))
    table = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert len(table.columns) == 10
    assert {r["duration_ms"] for r in table.collect()} == {"1.234", "1.000"}
    assert export.text_traces(t).orderBy("value").first()[0] == (
        "1970-01-01T00:00:01.000Z svc a 1.234ms trace_id=t1")
    assert export.text_logs(lg).first()[0] == '1970-01-01T00:00:01.000Z svc [Error] say "hi"'
    assert {r[0] for r in export.text_metrics(p).collect()} == {
        "svc m (1) [Gauge] d", "svc n (1) [Unknown] d"}
    counts = {r["metric_name"]: r["data_point_count"] for r in dicts(export.export_metrics(p))}
    assert counts == {"m": 2, "n": 0}
    everything = export.export_all(t, lg, p).orderBy("part").collect()
    assert [json.loads(r["value"])["signal"] for r in everything] == [
        "trace", "trace", "log", "metric", "metric"]
    export.write_text(export.text_logs(lg), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 1


def test_export_then_import_files(spark, tmp_path):
    t, lg, p = small(spark)
    for name, rows in (("traces", export.export_traces(t)), ("logs", export.export_logs(lg)),
                       ("metrics", export.export_metrics(p))):
        text = "\n".join(r[0] for r in export.json_lines(rows).collect())
        # Imported ids are hexadecimal.
        text = re.sub(r'(_id":")([^"]+)"', lambda m: f'{m[1]}{m[2].encode().hex()}"', text)
        (tmp_path / f"my-{name}.jsonl").write_text(text + "\n\n")
    back = jsonl.import_files(spark, f"{tmp_path}/*.jsonl")
    assert back["traces"].count() == 2
    row = dicts(back["traces"].where("span_name = 'a'"))[0]
    assert (row["status_code"], row["status_message"], row["trace_id"]) == (2, "m", "7431")
    assert dicts(back["logs"])[0]["body"] == 'say "hi"'
    assert back["metrics"].count() == 2


def test_store_appends_reloads_and_clears(spark, tmp_path):
    root = str(tmp_path)
    t, lg, p = small(spark)
    assert store.load(spark, root, "traces").count() == 0
    store.save(t, root, "traces")
    store.save(t, root, "traces")
    store.save(lg, root, "logs")
    store.save(p, root, "metrics")
    assert store.load(spark, root, "traces").count() == 4
    loaded = dicts(store.load(spark, root, "traces").where("span_name = 'a'"))[0]
    assert loaded["resource"] == {"service.name": "svc"} and loaded["duration_ns"] == 1234 * 1000
    store.register_saved(spark, root)
    assert spark.sql("SELECT * FROM metrics").count() == 3
    assert store.clear(spark, root, "traces") == 4
    assert store.load(spark, root, "traces").count() == 0
    assert store.clear_all(spark, root) == {"traces": 0, "logs": 1, "metrics": 3}


def test_repeated_batch_counts_once(spark, tmp_path):
    t, _, _ = small(spark)
    store.save(t, str(tmp_path), "traces", batch_id=1)
    store.save(t, str(tmp_path), "traces", batch_id=2)
    store.save(t, str(tmp_path), "traces", batch_id=2)
    assert store.load(spark, str(tmp_path), "traces").count() == 4


def test_sources_are_tagged(spark):
    t, _, _ = small(spark)
    both = store.union_sources({"http://one:1": t, "two:2": t})
    tags = {r["resource"]["source"] for r in dicts(both)}
    assert tags == {"one:1", "two:2"}
    assert both.count() == 4
    again = store.with_source(both, "three")
    assert {r["resource"]["source"] for r in dicts(again)} == {"three"}


def test_replay(spark):
    t, lg, p = small(spark)
    tables = {"traces": t, "logs": lg, "metrics": p}
    chosen = export.replay_selection(tables, since=2 * SECOND)
    got = {r["signal"]: r["records"] for r in dicts(export.replay_counts(chosen))}
    assert got == {"traces": 1, "logs": 0, "metrics": 0}
    assert list(export.replay_selection(tables, signal="logs")) == ["logs"]
    assert export.replay_selection(tables, service="nobody")["traces"].count() == 0


def test_replay_copies_to_another_store(spark, tmp_path):
    t, lg, p = small(spark)
    for name, df in {"traces": t, "logs": lg, "metrics": p}.items():
        store.save(df, str(tmp_path / "from"), name)
    tables = {s: store.load(spark, str(tmp_path / "from"), s) for s in store.SIGNALS}
    store.replay(export.replay_selection(tables, since=2 * SECOND), str(tmp_path / "to"))
    copied = store.load(spark, str(tmp_path / "to"), "traces")
    assert [r["span_name"] for r in copied.collect()] == ["b"]
    assert store.load(spark, str(tmp_path / "to"), "logs").count() == 0


def test_fan_out_isolates_failures(spark, tmp_path):
    t, _, _ = small(spark)

    def broken(_):
        raise RuntimeError("target is down")

    result = targets.fan_out(t, {
        "bad": broken,
        "good": lambda df: df.write.mode("append").parquet(str(tmp_path / "copy")),
    }, 7)
    errors = {r["target"]: r["error"] for r in dicts(result)}
    assert errors == {"bad": "target is down", "good": None}
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_rotation_by_size_and_time(spark, tmp_path):
    df = spans(spark, [{"start": i * 600 * SECOND, "duration": MS} for i in range(13)])
    rows = export.json_lines(export.export_traces(df)).select("value")
    lines_in = targets.rotation_lines(df, "traces", "start_time_unix_nano", 3600)
    targets.write_rotating(lines_in.coalesce(1), str(tmp_path / "r"), 1024, 512)
    assert rows.count() == 13
    back = spark.read.text(str(tmp_path / "r"))
    assert back.count() == 13
    intervals = sorted(p.name for p in (tmp_path / "r" / "signal=traces").iterdir())
    assert intervals == ["interval_start=0", "interval_start=3600", "interval_start=7200"]
    files = list((tmp_path / "r" / "signal=traces" / "interval_start=0").glob("part-*"))
    assert len(files) == 3


def test_rotation_by_real_size(spark, tmp_path):
    """No file is larger than the limit and one line, whatever the size of the records."""
    values = ["x" * 50_000 + str(i) for i in range(30)] + [f"ü{i}" * 40 for i in range(300)] + ["same"] * 50
    rows = [("traces" if i % 3 else "logs", 3600 * (i % 2), v) for i, v in enumerate(values)]
    lines = spark.createDataFrame(rows, "signal string, interval_start long, value string")
    limit = 60_000
    targets.write_rotating_by_size(lines, str(tmp_path / "r"), limit)
    back = spark.read.text(str(tmp_path / "r")).select("signal", "interval_start", "value")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    files = list((tmp_path / "r").rglob("part-*"))
    assert len(files) == len({f.parent for f in files})  # one file for each number
    sizes = [f.stat().st_size for f in files]
    assert max(sizes) <= limit + 50_003 and sum(sizes) == sum(len(v.encode()) + 1 for v in values)
    # Each is closed no earlier than at its limit: fewer files than half-full ones would make.
    assert len(files) <= sum(sizes) // limit + 4 + 1


def test_rotation_of_a_stream(spark, tmp_path):
    df = spans(spark, [{"start": i * 3600 * SECOND} for i in range(3)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = targets.start_rotating(
        targets.rotation_lines(stream, "traces", "start_time_unix_nano", 3600),
        str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(60)
    assert query.exception() is None
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    assert len(list((tmp_path / "out" / "signal=traces").iterdir())) == 3


def test_metric_types_survive_a_round_trip(spark):
    from spanforge.sinks.export import TYPE_NAMES
    from spanforge.sources import jsonl

    lines = spark.createDataFrame(
        [(f'{{"name": "m", "type": "{shown}", "value": 1.0}}',) for shown in TYPE_NAMES.values()], "value string"
    )
    assert {r["metric_type"] for r in jsonl.import_metrics(lines).collect()} == set(TYPE_NAMES)


def test_bad_hex_ids_fail(spark):
    import pytest

    from spanforge.sources import jsonl

    lines = spark.createDataFrame([('{"trace_id": "zz", "span_id": "ab"}',)], "value string")
    with pytest.raises(Exception, match="hexadecimal"):
        jsonl.import_traces(lines).collect()


def test_fan_out_keeps_the_callers_cache(spark):
    from spanforge.sinks.targets import fan_out

    batch = spark.range(5).persist()
    long_text = "x" * 5000

    def failing(df):
        raise ValueError(long_text)

    outcome = fan_out(batch, {"ok": lambda df: df.count(), "bad": failing}).collect()
    assert batch.is_cached and batch.storageLevel.useMemory
    assert {r["target"]: r["error"] for r in outcome} == {"ok": None, "bad": long_text}
    batch.unpersist()


def test_import_takes_defaults_for_other_types(spark):
    got = dicts(jsonl.import_traces(lines(
        spark, '{"service": 5, "duration_ms": "abc", "kind": 2.5, "trace_id": "AB"}'))
    )[0]
    assert (got["service_name"], got["duration_ns"], got["kind"]) == ("unknown", 0, 0)
    assert got["trace_id"] == "ab"
    point = dicts(jsonl.import_metrics(lines(
        spark, '{"name": ["x"], "value": "7", "unit": {"a": 1}}')))[0]
    assert (point["metric_name"], point["value"], point["unit"]) == ("", None, "")
    assert dicts(jsonl.import_logs(lines(spark, '{"body": true}')))[0]["body"] == ""


def test_bad_line_names_its_file(spark, tmp_path):
    (tmp_path / "logs.jsonl").write_text('{"body": "ok"}\nnot json\n')
    tables = jsonl.import_files(spark, f"{tmp_path}/*.jsonl")
    with pytest.raises(Exception, match=r"invalid JSON line: not json in .*logs\.jsonl"):
        tables["logs"].collect()


def test_slow_target_does_not_delay_the_others(spark):
    import threading

    from spanforge.sinks.targets import fan_out

    written = threading.Event()

    def slow(df):
        assert written.wait(60), "the other target waited for this one"
        df.count()

    def fast(df):
        df.count()
        written.set()

    def failing(df):
        raise RuntimeError("gone")

    batch = spark.range(5)
    outcome = [tuple(r) for r in fan_out(batch, {"slow": slow, "bad": failing, "fast": fast}, 7).collect()]
    assert outcome == [(7, "slow", None), (7, "bad", "gone"), (7, "fast", None)]
    assert fan_out(batch, {}).count() == 0


@pytest.mark.parametrize("shown", [export.csv_traces, export.text_traces])
def test_exported_durations_at_a_half(spark, shown):
    t = spans(spark, [{"duration": 32_072_500}])
    assert "32.072" in " ".join(str(v) for v in shown(t).first())


def test_import_reads_lines_of_any_types_alike(spark):
    """Lines with the expected types are read in one pass, others field by field, with one result."""
    odd = ['"x"', "5", "5.50", "1e3", "true", "null", "[1]", '{"a": 1}', "99999999999"]
    rows = []
    for i, (a, b) in enumerate((a, b) for a in odd for b in odd):
        rows.append(f'{{"service": "s{i}", "kind": {a}, "duration_ms": {b}, "more": 1}}')
        rows.append(f'{{"service": "t{i}", "kind": {a}, "duration_ms": {b}, "a b": [1]}}')  # never the one pass
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    fields = [f.strip().split(" ") for f in jsonl._FIELDS["traces"].split(",")]
    usual = df.where(jsonl._as_expected(F.try_parse_json("value"), fields)).count()
    assert usual == 3 * 5  # kinds 5, null and 99999999999 beside 5, 5.50, 1e3, null and 99999999999
    got = {r["service"]: (r["kind"], r["duration_ms"]) for r in jsonl._parsed(df, "traces").select("r.*").collect()}
    assert all(got[f"s{i}"] == got[f"t{i}"] for i in range(len(rows) // 2))
    assert got["s11"] == (5, 5.5) and got["s0"] == (None, None)


def test_import_does_not_write_its_lines_twice(spark):
    lines = export.json_lines(spark.range(3).selectExpr("string(id) AS service", "id AS kind"))
    found = jsonl.import_traces(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1
    assert sorted(r["service_name"] for r in found.collect()) == ["0", "1", "2"]
    blank = spark.createDataFrame([("  ",), ('{"service": "a"}',), ("",)], "value string")
    assert [r["service_name"] for r in jsonl.import_traces(blank).collect()] == ["a"]


def test_export_all_reads_each_line_once(spark):
    from spanforge.plans.queries import queries

    found = queries()["export_all"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("json_tuple") == 1
