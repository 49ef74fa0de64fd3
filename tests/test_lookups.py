import pytest
from builders import MS, SECOND, dicts, logs, points, spans
from pyspark.sql import functions as F

from spanforge.operators import lookups, traces
from spanforge.sources import store
from spanforge.sources.sql import as_text, columns, run_sql, sql, try_sql


def three(spark):
    return spans(spark, [
        {"name": "alpha", "service": "test-service", "trace": "aa", "start": 1 * SECOND},
        {"name": "beta", "service": "test-service", "trace": "bb", "start": 2 * SECOND,
         "attributes": {"http.method": "GET", "n": "1"}},
        {"name": "gamma", "service": "other-service", "trace": "cc", "start": 3 * SECOND},
    ])


def names(df):
    return [r["span_name"] for r in df.collect()]


def test_span_filters(spark):
    df = three(spark)
    assert names(lookups.find_spans(df)) == ["gamma", "beta", "alpha"]
    assert names(lookups.find_spans(df, service="test-service")) == ["beta", "alpha"]
    assert names(lookups.find_spans(df, service_contains="OTHER")) == ["gamma"]
    assert names(lookups.find_spans(df, span_name="beta")) == ["beta"]
    assert names(lookups.find_spans(df, trace_id="CC")) == ["gamma"]
    assert names(lookups.find_spans(df, since=2 * SECOND)) == ["gamma", "beta"]
    assert names(lookups.find_spans(df, until=2 * SECOND)) == ["beta", "alpha"]
    assert names(lookups.find_spans(df, limit=2)) == ["gamma", "beta"]
    assert names(lookups.find_spans(df, attributes={"http.method": "GET", "n": "1"})) == ["beta"]
    assert names(lookups.find_spans(df, attributes={"http.method": "GET", "n": "2"})) == []
    with pytest.raises(ValueError):
        lookups.find_spans(df, trace_id="xyz")


def test_log_filters(spark):
    df = logs(spark, [
        {"body": "disk full", "number": 17, "text": "ERROR", "time": 3},
        {"body": "all good", "number": 9, "text": "", "time": 2},
        {"body": "100% sure_thing", "number": 18, "text": "custom", "time": 1},
    ])

    def bodies(**conditions):
        return [r["body"] for r in lookups.find_logs(df, **conditions).collect()]

    assert bodies(severity="error") == ["disk full", "100% sure_thing"]
    assert bodies(severity="error2") == ["100% sure_thing"]
    assert bodies(severity="ERR", severity_mode="text_contains") == ["disk full"]
    assert bodies(severity="info", severity_mode="equals") == ["all good"]
    assert bodies(body="0% sure_") == ["100% sure_thing"]
    assert bodies(since=2, limit=1) == ["disk full"]
    with pytest.raises(ValueError):
        lookups.find_logs(df, severity="x", severity_mode="other")


def test_metric_filters(spark):
    df = points(spark, [{"name": "cpu", "service": "a", "value": 1.0},
                        {"name": "cpu", "service": "b", "value": 2.0},
                        {"name": "mem", "service": "a", "value": 3.0}])
    assert lookups.find_metrics(df, service="a", name="cpu").count() == 1
    assert lookups.find_metrics(df, resource={"service.name": "a"}).count() == 2
    assert lookups.search_metrics(df, "ME").count() == 1
    assert lookups.metric_catalog(df.unionByName(df)).count() == 3


def test_search(spark):
    groups = traces.trace_groups(three(spark))
    assert lookups.search_traces(groups, "OTHER").count() == 1
    assert lookups.search_traces(groups, "bb").count() == 1
    df = logs(spark, [{"number": 13, "body": "x"}, {"number": 9, "body": "WARNing"}])
    assert lookups.search_logs(df, "warn").count() == 2


def test_logs_with_trace(spark):
    df = logs(spark, [{"trace": "aa", "body": "in"}, {"trace": "", "body": "none"},
                      {"trace": "zz", "body": "lost"}])
    empty_id = spans(spark, [{"trace": ""}])
    groups = traces.trace_groups(three(spark).unionByName(empty_id))
    got = {r["body"]: r["root_span_name"] for r in dicts(lookups.logs_with_trace(df, groups))}
    assert got == {"in": "alpha", "none": None, "lost": None}


def test_time_range_prunes_dates(spark, tmp_path):
    day = 86_400 * SECOND
    df = spans(spark, [{"start": d * day + 5, "name": f"d{d}"} for d in range(4)])
    store.save(df, str(tmp_path), "traces")
    found = lookups.match_spans(store.load(spark, str(tmp_path), "traces"), since=2 * day)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1][:200]
    assert sorted(names(found)) == ["d2", "d3"]


def test_sql(spark):
    store.register(spark, {"traces": three(spark)})
    grouped = sql(spark, "SELECT service_name, COUNT(*) AS n FROM traces GROUP BY service_name")
    assert grouped.count() == 2
    assert columns(grouped) == [("service_name", "string"), ("n", "bigint")]
    by_key = sql(spark, "SELECT span_name FROM traces WHERE resource['service.name'] = "
                        "'other-service'")
    assert names(by_key) == ["gamma"]
    shown = as_text(sql(spark, "SELECT attributes['http.method'] AS m, resource FROM traces "
                               "ORDER BY span_name"))
    assert [r["m"] for r in shown.collect()] == ["NULL", "GET", "NULL"]
    assert shown.first()["resource"] == '{"service.name":"test-service"}'
    nothing = sql(spark, "SELECT span_name FROM traces WHERE false")
    assert nothing.columns == ["span_name"] and nothing.count() == 0
    result, error = try_sql(spark, "SELECT nope FROM traces")
    assert result is None and "nope" in error
    with pytest.raises(ValueError):
        store.register(spark, {"other": three(spark)})


def test_sql_errors_in_rows_are_texts(spark, tmp_path):
    store.register(spark, {"traces": three(spark)})
    folder = str(tmp_path)
    for text, part in [
        ("SELECT nope FROM traces", "nope"),
        ("SELEC 1", "SELEC"),
        ("SELECT CAST(span_name AS INT) AS n FROM traces", "cannot be cast"),
        ("SELECT 1 / (kind - kind) AS n FROM traces", "zero"),
        ("SELECT raise_error('row of ' || service_name) AS n FROM traces", "row of"),
    ]:
        result, error = run_sql(spark, text, folder)
        assert result is None and part.lower() in error.lower(), text
    result, error = run_sql(
        spark, "SELECT span_name, attributes['n'] AS n FROM traces ORDER BY span_name", folder)
    assert error is None
    assert sorted(tuple(r) for r in result.collect()) == [
        ("alpha", "NULL"), ("beta", "1"), ("gamma", "NULL")]
    empty, error = run_sql(spark, "SELECT span_name FROM traces WHERE false", folder)
    assert error is None and empty.columns == ["span_name"] and empty.count() == 0


def test_display_rows(spark):
    df = three(spark).withColumn("events_count", F.lit(1)).withColumn("links_count", F.lit(0))
    row = dicts(traces.display_rows(df.orderBy("span_name")))[0]
    assert (row["time"], row["duration"], row["kind"], row["status"]) == (
        "00:00:01.000", "1.00ms", "INTERNAL", "UNSET")
    assert MS == 1_000_000


def test_derived_children_are_sorted_once(spark):
    """The join with their orders hashes, so that only the window that numbers lines sorts them."""
    from spanforge.plans import fixtures

    children = fixtures.child_spans(spark, "/root/testdata/sf0.001")
    plan = children._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
