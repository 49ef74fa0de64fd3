import random

import pytest
from builders import MS, SECOND, dicts, logs, points, spans
from pyspark.sql import functions as F

from spanforge.operators import alerts, chains, ranking
from spanforge.session import cut_lineage

MINUTE = 60 * SECOND


def parsed(spark, *texts):
    rows = dicts(alerts.parse_rules(alerts.rules_frame(spark, list(texts))))
    return {r["rule"]: r for r in rows}


def test_rule_texts(spark):
    got = parsed(
        spark, "span_duration > 5s", "span_duration > 500ms", "error_rate > 10/min",
        "error_rate > 3/5m", "log_body contains 'it's bad'", "log_severity >= warning",
        "metric memory.free <= 100.0", "metric cpu>9", "  metric a.b = -1.5 ")
    assert got["span_duration > 5s"]["threshold_ns"] == 5 * SECOND
    assert got["span_duration > 500ms"]["threshold_ns"] == 500 * MS
    rate = got["error_rate > 10/min"]
    assert (rate["max_count"], rate["window_ns"]) == (10, MINUTE)
    assert got["error_rate > 3/5m"]["window_ns"] == 5 * MINUTE
    assert got["log_body contains 'it's bad'"]["pattern"] == "it's bad"
    assert got["log_severity >= warning"]["min_severity"] == 13
    metric = got["metric memory.free <= 100.0"]
    assert (metric["metric_name"], metric["op"], metric["threshold"]) == (
        "memory.free", "<=", 100.0)
    assert got["metric cpu>9"]["metric_name"] == "cpu"
    assert got["metric a.b = -1.5"]["threshold"] == -1.5
    assert all(r["error"] is None for r in got.values())


@pytest.mark.parametrize("text", [
    "nonsense", "span_duration < 5s", "span_duration > 5x", "span_duration > s",
    "error_rate > 10", "error_rate > x/min", "log_body contains panic",
    "log_severity >= LOUD", "metric cpu 9", "metric > 5", "metric cpu > high", ""])
def test_rejected_texts(spark, text):
    assert parsed(spark, text)[text]["error"] is not None


def hits_of(spark, rules, traces=(), log_rows=(), metric_rows=()):
    frame = alerts.parse_rules(alerts.rules_frame(spark, rules))
    hits = alerts.evaluate_rules(
        frame, spans(spark, list(traces)) if traces else spans(spark, [{}]).where("false"),
        logs(spark, list(log_rows)) if log_rows else logs(spark, [{}]).where("false"),
        points(spark, list(metric_rows)) if metric_rows else points(spark, [{}]).where("false"))
    return sorted((r["rule"], r["at"], r["message"]) for r in hits.collect())


def test_span_duration(spark):
    rows = [{"name": "slow", "duration": 2 * SECOND, "start": 7}, {"duration": SECOND}]
    assert hits_of(spark, ["span_duration > 1s"], rows) == [
        ("span_duration > 1s", 7, "span 'slow' duration 2.000s exceeds threshold 1.000s")]
    assert hits_of(spark, ["span_duration > 5s"], rows) == []


def test_error_rate(spark):
    rows = [{"status": 2, "start": i * SECOND} for i in range(3)] + [{"status": 0}]
    assert hits_of(spark, ["error_rate > 2/1m"], rows) == [
        ("error_rate > 2/1m", 2 * SECOND, "error rate 3 exceeds threshold 2 in 60s window")]
    assert hits_of(spark, ["error_rate > 5/1m"], rows) == []


def test_logs_and_metrics(spark):
    long = "panic " + "x" * 200
    log_rows = [{"body": long, "number": 17, "time": 1}, {"body": "ok", "number": 13, "time": 2}]
    got = hits_of(spark, ["log_body contains 'panic'", "log_severity >= ERROR"],
                  log_rows=log_rows)
    assert got == [
        ("log_body contains 'panic'", 1, f"log body contains 'panic': {long[:100]}..."),
        ("log_severity >= ERROR", 1, f"log severity 17 >= 17: {long[:100]}...")]
    metric_rows = [{"name": "cpu", "value": 95.5, "time": 3}, {"name": "cpu", "value": 1.0},
                   {"name": "cpu", "type": "summary", "value": 99.0},
                   {"name": "mem", "value": 99.0}]
    assert hits_of(spark, ["metric cpu > 90"], metric_rows=metric_rows) == [
        ("metric cpu > 90", 3, "metric 'cpu' value 95.5 triggered (threshold 90)")]
    assert len(hits_of(spark, ["metric cpu = 1", "metric cpu < 2"], metric_rows=metric_rows)) == 2


def test_single_conditions(spark):
    assert alerts.slow_spans(spans(spark, [{"duration": 5}, {"duration": 6}]), 5).count() == 1
    assert alerts.logs_containing(logs(spark, [{"body": "a%b"}]), "%").count() == 1
    assert alerts.logs_at_least(logs(spark, [{"number": 13}, {"number": 12}]), "WARN").count() == 1
    with pytest.raises(ValueError):
        alerts.logs_at_least(logs(spark, [{}]), "LOUD")
    with pytest.raises(ValueError):
        alerts.metric_over(points(spark, [{}]), "m", "!=", 1.0)


def test_error_counts_against_brute_force(spark):
    rng = random.Random(8)
    times = [rng.choice([10, 10, rng.randrange(1 << 30), rng.randrange(1 << 40)])
             for _ in range(300)]
    window = 1 << 28
    df = spark.createDataFrame([(t,) for t in times], "at bigint")
    got = {r["at"]: r["errors_in_window"] for r in alerts.error_counts(df, window).collect()}
    assert got == {t: sum(1 for u in times if t - window <= u <= t) for t in set(times)}
    later, earlier = df.where(F.col("at") >= 1 << 29), df.where(F.col("at") < 1 << 29)
    split = {r["at"]: r["errors_in_window"]
             for r in alerts.error_counts(later, window, history=earlier).collect()}
    assert split == {t: n for t, n in got.items() if t >= 1 << 29}


def greedy(times, gap, last=None):
    fired = []
    for t in sorted(set(times)):
        if last is None or t >= last + gap:
            fired.append(t)
            last = t
    return fired


def test_cooldown(spark):
    rng = random.Random(6)
    per_rule = {
        "hot": [rng.randrange(40 * MINUTE) for _ in range(500)],
        "steady": [i * 20 * SECOND for i in range(100)],
        "rare": [0, 59 * SECOND, 60 * SECOND, 10 * MINUTE],
        "once": [5],
    }
    rows = [(r, t) for r, ts in per_rule.items() for t in ts]
    hits = spark.createDataFrame(rows + rows[:50], "rule string, at bigint")
    got = {}
    for r in alerts.cooldown(hits, MINUTE).collect():
        got.setdefault(r["rule"], []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {
        k: greedy(v, MINUTE) for k, v in per_rule.items()}
    last = spark.createDataFrame([("hot", 5 * MINUTE), ("hot", 1)], "rule string, fired_at bigint")
    again = alerts.cooldown(hits, MINUTE, last).where("rule = 'hot'")
    assert sorted(r["at"] for r in again.collect()) == [
        t for t in greedy([t for t in per_rule["hot"] if t >= 6 * MINUTE], MINUTE)]


def test_cooldown_in_chunks(spark):
    rng = random.Random(16)
    top = (1 << 63) - 1
    per_rule = {
        "dense": sorted({rng.randrange(3_000) for _ in range(900)}),
        "even": list(range(0, 4_000, 7)),
        "gaps": sorted({rng.randrange(50) + 1_000 * i for i in range(30) for _ in range(5)}),
        "ends": [-top, -5, 0, top - 3],
        "once": [5],
    }
    rows = [(r, t) for r, ts in per_rule.items() for t in ts]
    times = spark.createDataFrame(rows, "rule string, at bigint")
    for silence, most in ((100, 7), (13, 1), (2_500, 50)):
        got = {}
        for r in chains.fires(times, silence, most).collect():
            got.setdefault(r["rule"], []).append(r["at"])
        assert {k: sorted(v) for k, v in got.items()} == {
            k: greedy(v, silence) for k, v in per_rule.items()}, (silence, most)


def test_cooldown_of_nothing_and_of_no_length(spark):
    hits = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 2), ("b", 2), (None, 3), ("b", None)], "rule string, at bigint")
    every = {(r["rule"], r["at"]) for r in alerts.cooldown(hits, 0).collect()}
    assert every == {("a", 1), ("a", 2), ("b", 2)}
    assert alerts.cooldown(hits.where("false"), 5).count() == 0


def test_cooldown_follows_no_link_per_hit(spark, monkeypatch):
    stored = []

    def counted(df):
        stored.append(df)
        return cut_lineage(df)

    for module in (alerts, ranking, chains):
        monkeypatch.setattr(module, "cut_lineage", counted)
    hits = spark.range(4_000).select(F.lit("r").alias("rule"), F.col("id").alias("at"))
    assert alerts.cooldown(hits, 10).count() == 400
    # One link and one step between chunks, whatever the number of fires in them.
    assert len(stored) <= 4 + 2 * 3


def test_same_event_twice_fires_once(spark):
    rows = [{"duration": 2 * SECOND}, {"duration": 2 * SECOND}]
    frame = alerts.parse_rules(alerts.rules_frame(spark, ["span_duration > 1s"]))
    hits = alerts.evaluate_rules(frame, spans(spark, rows), logs(spark, [{}]).where("false"),
                                 points(spark, [{}]).where("false"))
    assert hits.count() == 2
    assert alerts.alert_rows(hits).count() == 1


def test_many_rules_and_a_hot_metric(spark):
    """Thousands of rules of every kind meet their rows without a cartesian product."""
    texts = [f"span_duration > {i}ms" for i in range(1, 3001)]
    rules = alerts.parse_rules(alerts.rules_frame(spark, texts))
    spans = spark.createDataFrame(
        [("a", i * 1_000_000, 0, 0) for i in (0, 1, 10, 2999, 5000)],
        "span_name string, duration_ns bigint, start_time_unix_nano bigint, status_code int",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = alerts.evaluate_rules(rules, spans, None, None)
        plan = hits._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert hits.count() == 0 + 0 + 9 + 2998 + 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_messages_are_cut_by_bytes(spark):
    body = "é" * 60
    row = spark.createDataFrame([(body,), ("x" * 99 + "é",), ("short",)], "body string").select(
        alerts._cut(F.col("body")).alias("m")
    )
    assert [r["m"] for r in row.collect()] == ["é" * 50 + "...", "x" * 99 + "...", "short"]


def test_twenty_thousand_rules_of_each_kind(spark):
    """Rows meet the rules they pass and no others, whatever the length of the list."""
    n = 20_000
    rules = [f"span_duration > {100 + i}ms" for i in range(n)]
    rules += [f"log_body contains 'token-{i:05d}-'" for i in range(n)]
    rules += [f"metric cpu > {i}" for i in range(n)] + [f"metric mem <= {i}.5" for i in range(n)]
    rules += [f"metric disk = {i}" for i in range(n)]
    rules += [f"error_rate > {i}/{m}m" for m in (1, 2) for i in range(n // 2)]
    rules += ["log_severity >= WARN", "log_severity >= ERROR", "log_severity >= TRACE"]
    rows = [{"duration": 103 * MS + 1, "start": 5}, {"duration": 100 * MS, "start": 6}]
    rows += [{"status": 2, "duration": 1, "start": i * SECOND} for i in range(3)]
    log_rows = [{"body": "a token-00007- and token-19999- token-00007-", "number": 13, "time": 1},
                {"body": "token-7-", "number": 24, "time": 2}, {"body": None, "number": 0, "time": 3}]
    metric_rows = [{"name": "cpu", "value": 2.0, "time": 1}, {"name": "mem", "value": 19997.5, "time": 2},
                   {"name": "disk", "value": 12.0, "time": 3}, {"name": "disk", "value": 12.5, "time": 4},
                   {"name": "other", "value": 1.0, "time": 5}]
    got = [(r, at) for r, at, _ in hits_of(spark, rules, rows, log_rows, metric_rows)]
    want = [(f"span_duration > {d}ms", 5) for d in (100, 101, 102, 103)]
    want += [("log_body contains 'token-00007-'", 1), ("log_body contains 'token-19999-'", 1)]
    want += [("log_severity >= WARN", 1), ("log_severity >= TRACE", 1)]
    want += [(f"log_severity >= {s}", 2) for s in ("WARN", "ERROR", "TRACE")]
    want += [("metric cpu > 0", 1), ("metric cpu > 1", 1), ("metric disk = 12", 3)]
    want += [(f"metric mem <= {i}.5", 2) for i in (19997, 19998, 19999)]
    want += [(f"error_rate > {i}/{m}m", at * SECOND) for m in (1, 2) for at in range(3) for i in range(at + 1)]
    assert got == sorted(want)


def test_comparisons_against_brute_force(spark):
    """Ties, epsilons, infinities and not-a-numbers on both sides."""
    values = [0.0, -0.0, 1.0, 1.0 + 1e-16, 1.0 + 3e-16, -5.0, 1e300, float("inf"), float("-inf"), float("nan"), 2.0]
    texts = ["0", "1", "1.0000000000000002", "-5", "1e300", "Infinity", "-Infinity", "NaN", "2"]
    rules = [f"metric m {op} {t}" for op in (">", "<", ">=", "<=", "=") for t in texts]
    rows = [{"name": "m", "value": v, "time": i} for i, v in enumerate(values)]
    got = {(r, at) for r, at, _ in hits_of(spark, rules, metric_rows=rows)}
    parsed_rules = alerts.parse_rules(alerts.rules_frame(spark, rules)).collect()
    for rule in parsed_rules:
        met = points(spark, rows).where(alerts.compare(F.col("value"), F.lit(rule["op"]), F.lit(rule["threshold"])))
        assert {r["timestamp_unix_nano"] for r in met.collect()} == {at for r, at in got if r == rule["rule"]}, rule["rule"]


def test_patterns_inside_each_other(spark):
    rules = [f"log_body contains '{p}'" for p in ("", "a", "ab", "b", "abc", "ü", "x")]
    got = hits_of(spark, rules, log_rows=[{"body": "zabü", "time": 1}, {"body": "", "time": 2}, {"body": None, "time": 3}])
    want = [(f"log_body contains '{p}'", 1) for p in ("", "a", "ab", "b", "ü")] + [("log_body contains ''", 2)]
    assert [(r, at) for r, at, _ in got] == sorted(want)


def test_errors_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    errors = spark.range(0, 50, numPartitions=2).select((F.col("id") % 10).alias("at")).mapInArrow(told, "at long")
    counts = {r["at"]: r["errors_in_window"] for r in alerts.error_counts(errors, 2).collect()}
    assert counts == {0: 5, 1: 10, **dict.fromkeys(range(2, 10), 15)}
    assert seen.value == 50
