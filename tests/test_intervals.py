"""The interval join against brute force, with one key holding most rows."""

import random

import pytest
from builders import SECOND, logs, spans

from spanforge.operators.intervals import logs_in_spans, points_in_intervals

EDGE = 2**63 - 1


def brute(points, intervals):
    return sorted(
        (k, p, a, i)
        for k, a, p in points
        for other, b, e, i in intervals
        if k is not None and k == other and None not in (a, b, e) and b <= a <= e
    )


@pytest.mark.parametrize("reach", [6, 1000, 1 << 40])
def test_against_brute_force(spark, reach):
    rng = random.Random(reach)

    def key():
        return "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "", None])

    def time():
        return rng.choice([None, 0, rng.randrange(-reach, reach), rng.randrange(-reach, reach)])

    points = [(key(), time(), n) for n in range(300)] + [("hot", 0, 0)] * 3
    points += [("hot", EDGE, -1), ("hot", -EDGE - 1, -2)]
    intervals = []
    for n in range(200):
        begin = time()
        length = rng.choice([0, 1, 7, 8, rng.randrange(reach), -1])
        intervals.append((key(), begin, begin if begin is None else begin + length, n))
    intervals += [("hot", 0, None, -1), ("hot", -EDGE - 1, EDGE, -2), ("hot", EDGE, EDGE, -3)] + intervals[:3]
    got = points_in_intervals(
        spark.createDataFrame(points, "k string, at bigint, p int"),
        spark.createDataFrame(intervals, "k string, b bigint, e bigint, i int"),
        ["k"], "at", "b", "e",
    )
    rows = sorted((r["k"], r["p"], r["at"], r["i"]) for r in got.collect())
    want = brute(points, intervals)
    assert rows == want and want


def test_candidates_stay_near_the_intervals(spark):
    """A hot key of short intervals: what the join gives before its last filter is not quadratic."""
    n = 20_000
    points = spark.range(n).selectExpr("id % 1 AS k", "id * 100 AS at", "id AS p")
    intervals = spark.range(n).selectExpr("id % 1 AS k", "id * 100 AS b", "id * 100 + 150 AS e", "id AS i")
    df = points_in_intervals(points, intervals, ["k"], "at", "b", "e")
    assert df.count() == 2 * n - 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_logs_in_spans(spark):
    tree = spans(spark, [
        {"trace": "t", "span": "root", "start": SECOND, "duration": 2 * SECOND},
        {"trace": "t", "span": "child", "start": 2 * SECOND},
        {"trace": "", "span": "none", "start": SECOND, "duration": 2 * SECOND},
    ])
    records = logs(spark, [
        {"trace": "t", "body": "both", "time": 2 * SECOND},
        {"trace": "t", "body": "last", "time": 3 * SECOND},
        {"trace": "t", "body": "after", "time": 3 * SECOND + 1},
        {"trace": "", "body": "no trace", "time": 2 * SECOND},
        {"trace": "u", "body": "unknown", "time": 2 * SECOND},
    ])
    got = {(r["body"], r["inside_span_id"]): r["since_start_ns"] for r in logs_in_spans(records, tree).collect()}
    assert got == {("both", "root"): SECOND, ("both", "child"): 0, ("last", "root"): 2 * SECOND}
