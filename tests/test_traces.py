import pytest
from builders import MS, dicts, spans

from spanforge.operators import diff, outliers, services, traces


def test_trace_groups_root_and_fallback(spark):
    df = spans(spark, [
        {"trace": "a", "name": "child", "span": "2", "parent": "1", "start": 50, "duration": 100},
        {"trace": "a", "name": "root", "span": "1", "start": 60, "duration": 20, "service": "r"},
        {"trace": "b", "name": "late", "span": "4", "parent": "x", "start": 90, "duration": 1},
        {"trace": "b", "name": "early", "span": "3", "parent": "x", "start": 80, "duration": 5},
    ])
    got = {r["trace_id"]: r for r in dicts(traces.trace_groups(df))}
    assert got["a"]["root_span_name"] == "root" and got["a"]["service_name"] == "r"
    assert got["a"]["start_time_unix_nano"] == 60
    assert (got["a"]["span_count"], got["a"]["duration_ns"]) == (2, 100)
    assert got["b"]["root_span_name"] == "early"
    assert got["b"]["duration_ns"] == 11
    order = [r["trace_id"] for r in dicts(traces.in_group_order(traces.trace_groups(df)))]
    assert order == ["a", "b"]


def tree_of(df, **options):
    rows = dicts(traces.in_tree_order(traces.span_tree(df, **options)))
    return [(r["trace_id"], r["name"] if "name" in r else r["span_name"], r["depth"])
            for r in rows]


def test_tree_order_two_roots_and_orphans(spark):
    df = spans(spark, [
        {"name": "r2", "span": "b0", "start": 50},
        {"name": "r1", "span": "a0", "start": 10},
        {"name": "c2", "span": "a2", "parent": "a0", "start": 30},
        {"name": "c1", "span": "a1", "parent": "a0", "start": 20},
        {"name": "g", "span": "a3", "parent": "a1", "start": 40},
        {"name": "orphan", "span": "o", "parent": "zz", "start": 5},
        {"name": "under", "span": "u", "parent": "o", "start": 6},
    ])
    wanted = [("r1", 0), ("c1", 1), ("g", 2), ("c2", 1), ("r2", 0)]
    assert [(n, d) for _, n, d in tree_of(df)] == wanted
    kept = [(n, d) for _, n, d in tree_of(df, keep_orphans=True)]
    assert kept == [("orphan", 0), ("under", 1), *wanted]


def test_tree_without_root_and_with_cycle(spark):
    df = spans(spark, [
        {"trace": "x", "name": "first", "span": "1", "parent": "2", "start": 1},
        {"trace": "x", "name": "second", "span": "2", "parent": "1", "start": 2},
        {"trace": "y", "name": "root", "span": "1", "start": 1},
        {"trace": "y", "name": "loop1", "span": "8", "parent": "9", "start": 2},
        {"trace": "y", "name": "loop2", "span": "9", "parent": "8", "start": 3},
    ])
    assert tree_of(df) == [("x", "first", 0), ("x", "second", 1), ("y", "root", 0)]


def test_deep_chain_and_copies(spark):
    depth = 100
    rows = [{"name": f"n{i}", "span": f"{i:04d}", "parent": f"{i - 1:04d}" if i else "",
             "start": 1000 + i} for i in range(depth)]
    df = spans(spark, rows + [rows[7]])
    got = dicts(traces.in_tree_order(traces.span_tree(df)))
    assert len(got) == depth + 1
    assert sorted(r["depth"] for r in got) == sorted([*range(depth), 7])
    assert [r["depth"] for r in got] == sorted(r["depth"] for r in got)


def test_chain_of_ten_thousand_spans(spark):
    """Numbers only: a deep chain takes about log2 rounds and no more state than spans."""
    depth = 10_000
    df = spark.range(depth).selectExpr(
        "'t' AS trace_id", "lpad(string(id), 6, '0') AS span_id", "id AS start_time_unix_nano",
        "CASE WHEN id = 0 THEN '' ELSE lpad(string(id - 1), 6, '0') END AS parent_span_id")
    got = traces.span_tree(df)
    wrong = "depth != start_time_unix_nano OR position != depth OR subtree_size != 10000 - depth"
    assert got.count() == depth and got.where(wrong).isEmpty()


def test_span_with_very_many_children(spark):
    """Siblings run over several ranges; their subtrees are summed across them."""
    df = spark.range(1, 30_000).selectExpr(
        "'t' AS trace_id", "lpad(string(id), 6, '0') AS span_id",
        "IF(id % 3 = 0, lpad(string(id - 1), 6, '0'), 'r') AS parent_span_id",
        "5 AS start_time_unix_nano").unionByName(spark.sql(
            "SELECT 't' AS trace_id, 'r' AS span_id, '' AS parent_span_id, 9 AS start_time_unix_nano"))
    got = {r["span_id"]: (r["depth"], r["position"], r["subtree_size"]) for r in traces.span_tree(df).collect()}
    assert got.pop("r") == (0, 0, 30_000)
    for span, found in got.items():
        i = int(span)
        assert found == (2 if i % 3 == 0 else 1, i, 2 if i % 3 == 2 and i + 1 < 30_000 else 1)


def tree_by_recursion(rows, keep_orphans):
    """(trace, span, parent, start) to depth, position, subtree size and orphan, one trace at a time."""
    out = {}
    for trace in {r[0] for r in rows}:
        mine = {r for r in rows if r[0] == trace}
        first = {}
        for r in sorted(mine, key=lambda r: (r[3], r[2])):
            first.setdefault(r[1], r)
        roots = [r for r in mine if r[2] == ""]
        if not roots:
            start, span = min((r[3], r[1]) for r in mine)
            roots = [r for r in mine if (r[3], r[1]) == (start, span)]
        tops = [(r, False) for r in roots]
        if keep_orphans:
            tops += [(r, True) for r in mine if r not in roots and r[2] not in first]
        count = 0

        def visit(r, depth, orphan, roots=roots, mine=mine, first=first):
            nonlocal count
            at, count = count, count + 1
            if first[r[1]] == r:
                for c in sorted((c for c in mine if c[2] == r[1] and c not in roots), key=lambda c: (c[3], c[1])):
                    visit(c, depth + 1, orphan)
            out[r] = (depth, at, count - at, orphan)

        for r, orphan in sorted(tops, key=lambda t: (t[0][3], t[0][1])):
            visit(r, 0, orphan)
    return out


@pytest.mark.parametrize("keep_orphans", [False, True])
def test_trees_against_recursion(spark, keep_orphans):
    """Several roots, orphans, rootless traces, cycles, repeated ids and copies."""
    import random

    rng = random.Random(12)
    rows = set()
    for t in range(120):
        n = rng.randrange(1, 14)
        for i in range(n):
            parent = rng.choice(["", "missing", *[f"s{rng.randrange(n)}"] * 8])
            span = f"s{i}" if rng.random() < 0.95 else f"s{rng.randrange(n)}"
            # Times differ inside a trace, so that equal ids have one earliest span.
            rows.add((f"t{t}", span, parent, 100 * rng.randrange(50) + i))
    rows = sorted(rows)
    ddl = "trace_id string, span_id string, parent_span_id string, start_time_unix_nano long"
    got = traces.span_tree(spark.createDataFrame(rows + rows[:40], ddl), keep_orphans).collect()
    found = {tuple(r)[:4]: (r["depth"], r["position"], r["subtree_size"], r["orphan"]) for r in got}
    expected = tree_by_recursion(set(rows), keep_orphans)
    assert found == expected
    assert len(got) == len(expected) + sum(r in expected for r in rows[:40])


@pytest.mark.parametrize("keep_orphans", [False, True])
def test_trees_of_large_traces_are_those_of_small_ones(spark, keep_orphans, monkeypatch):
    """Whole traces in a task, larger ones spread over tasks, and both in one table."""
    df = spark.sql("""
        SELECT concat('t', t) AS trace_id, concat('s', i) AS span_id, i % 7 * 10 + i AS start_time_unix_nano,
               CASE WHEN i = 0 AND t % 3 > 0 THEN '' WHEN i % 9 = 8 THEN 'missing' WHEN i % 9 = 7 THEN concat('s', i)
                    ELSE concat('s', (i * 5 + t) % (i + 1)) END AS parent_span_id, map('k', i) AS attributes
        FROM (SELECT explode(sequence(1, 30)) AS t) LATERAL VIEW explode(sequence(0, t)) AS i""")
    got = []
    for most in (100_000, 15, 0):
        monkeypatch.setattr(traces, "WHOLE_SPANS", most)
        got.append(sorted(map(str, traces.span_tree(df, keep_orphans).collect())))
    assert got[0] and got[0] == got[1] == got[2]


def test_span_tree_numbers_whole_traces_in_one_shuffle(spark, monkeypatch):
    """Batches end anywhere; ids are compared as they are, not by hashes, and rows move once."""
    from spanforge.operators import trees

    monkeypatch.setattr(trees, "ROWS", 10)
    df = spark.range(3000).selectExpr(
        "string(id div 25) AS trace_id", "string(id % 25) AS span_id", "id % 25 AS start_time_unix_nano",
        "IF(id % 25 = 0, '', string((id % 25 - 1) div 2)) AS parent_span_id")
    tree = traces.span_tree(df)
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    wrong = "depth != int(log2(start_time_unix_nano + 1)) OR (position = 0) != (parent_span_id = '')"
    assert tree.count() == 3000 and tree.where(wrong).isEmpty()
    assert tree.where("subtree_size = 25").count() == 120


def test_diff_of_large_pairs_is_that_of_small_ones(spark, monkeypatch):
    """Pairs ranked in a task and by ranges; small ones are shuffled once for ranks and sides."""
    df = spark.sql("""
        SELECT concat('t', t) AS trace_id, lpad(string(i), 3, '0') AS span_id, concat('n', i % 3) AS span_name,
               's' AS service_name, i div 5 AS start_time_unix_nano, i * 7 % 11 AS duration_ns
        FROM (SELECT explode(sequence(1, 12)) AS t) LATERAL VIEW explode(sequence(1, t * 3)) AS i""")
    pairs = spark.sql("SELECT id AS pair_id, concat('t', id) AS trace_a, concat('t', id * 2) AS trace_b FROM range(1, 9)")
    got = []
    for most in (100_000, 30, 0):
        monkeypatch.setattr(diff, "WHOLE_SPANS", most)
        found = diff.trace_diff(df, pairs, 10.0)
        got.append(sorted(map(str, found.collect())))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert most < 100_000 or ("Window" in plan and "_range" not in plan)
    assert len(got[0]) > 100 and got[0] == got[1] == got[2]


def test_waterfall(spark):
    df = spans(spark, [
        {"trace": "a", "span": "1", "start": 100, "duration": 1000},
        {"trace": "a", "span": "2", "start": 600, "duration": 1},
        {"trace": "z", "span": "3", "start": 5, "duration": 0},
    ])
    got = {r["span_id"]: (r["left_pct"], r["width_pct"])
           for r in dicts(traces.waterfall_layout(df))}
    assert got == {"1": (0.0, 100.0), "2": (50.0, 0.5), "3": (0.0, 0.5)}


def test_service_map_copies_and_span_ids(spark):
    rows = [
        {"trace": "t1", "span": "p", "service": "web"},
        {"trace": "t1", "span": "c", "parent": "p", "service": "db", "duration": 2 * MS},
        {"trace": "t1", "span": "c", "parent": "p", "service": "db", "duration": 4 * MS},
        {"trace": "t1", "span": "i", "parent": "p", "service": "web"},
        {"trace": "t2", "span": "x", "parent": "p", "service": "cache", "duration": MS},
    ]
    df = spans(spark, rows + [rows[0]])

    def edges(**options):
        return {(r["caller_service"], r["callee_service"]): (r["call_count"], r["avg_duration_ms"])
                for r in dicts(services.service_map(df, **options))}

    assert edges() == {("web", "db"): (4, 3.0)}
    assert edges(match_trace=False) == {("web", "db"): (4, 3.0), ("web", "cache"): (2, 1.0)}
    lines = services.in_line_order(services.mermaid_lines(services.service_map(df)))
    assert [r["line"] for r in lines.collect()] == [
        "graph LR", '    web["web"] -->|4 calls, 3.0ms avg| db["db"]']
    text = services.in_line_order(services.text_lines(services.service_map(df)))
    assert [r["line"] for r in text.collect()][2:] == [
        "  web --(4 calls, avg 3.0ms)--> db", "Services: db, web"]
    assert services.text_lines(services.service_map(df.where("false"))).count() == 0


OUTLIER_NS = [100, 110, 105, 95, 100, 105, 98, 102, 5000]


def test_outliers(spark):
    df = spans(spark, [{"name": "op-a", "duration": d, "trace": str(i)}
                       for i, d in enumerate(OUTLIER_NS)]
               + [{"name": "op-b", "duration": d, "trace": "b"} for d in (500, 510, 505)]
               + [{"name": "single", "duration": 9999}]
               + [{"name": "equal", "duration": 7} for _ in range(3)])
    assert [r["duration_ns"] for r in dicts(outliers.outlier_spans(df))] == [5000]
    assert dicts(outliers.outlier_traces(df)) == [{"trace_id": "8", "outlier_spans": 1}]
    assert outliers.outlier_spans(df, 100.0).count() == 0
    assert outliers.tagged_spans(df).where("tag = '[SLOW]'").count() == 1


def diff_rows(spark, a, b, threshold=None):
    rows = [{"trace": "a", "name": n, "span": f"a{i}", "start": i, "duration": d * MS}
            for i, (n, d) in enumerate(a)]
    rows += [{"trace": "b", "name": n, "span": f"b{i}", "start": i, "duration": d * MS}
             for i, (n, d) in enumerate(b)]
    df = spans(spark, rows or [{"trace": "other"}])
    pairs = diff.one_pair(df, "a", "b")
    listed = dicts(diff.in_diff_order(diff.trace_diff(df, pairs, threshold)))
    return listed, dicts(diff.trace_diff_summary(df, pairs, threshold))[0]


def test_diff_matched(spark):
    rows, total = diff_rows(spark, [("op", 100)], [("op", 120)], 10.0)
    assert (rows[0]["status"], rows[0]["delta_ns"], rows[0]["pct_change"]) == (
        "matched", 20 * MS, 20.0)
    assert rows[0]["exceeds_threshold"] and total["exceeds_threshold"]
    assert (total["total_ns_a"], total["total_ns_b"]) == (100 * MS, 120 * MS)


def test_diff_pairs_in_order_and_leftovers(spark):
    rows, _ = diff_rows(
        spark, [("x", 30), ("x", 40), ("x", 50), ("gone", 1)], [("x", 35), ("x", 45), ("x", 55),
                                                             ("new", 2)])
    assert [r["status"] for r in rows] == ["matched"] * 3 + ["removed", "added"]
    assert [r["delta_ns"] for r in rows[:3]] == [5 * MS] * 3


def test_diff_empty_side(spark):
    rows, total = diff_rows(spark, [], [("x", 1), ("y", 2)])
    assert [r["status"] for r in rows] == ["added", "added"]
    assert total["total_ns_a"] == 0 and total["missing_a"] and total["pct_change"] == 0.0


@pytest.mark.parametrize("a,b,pct", [(0, 0, 0.0), (0, 5, 100.0)])
def test_diff_from_zero(spark, a, b, pct):
    rows, _ = diff_rows(spark, [("x", a)], [("x", b)])
    assert rows[0]["pct_change"] == pct


def test_diff_is_antisymmetric(spark):
    a, b = [("x", 3), ("y", 9), ("x", 4)], [("x", 8), ("y", 2)]
    forth, _ = diff_rows(spark, a, b)
    back, _ = diff_rows(spark, b, a)

    def deltas(rows):
        return sorted(r["delta_ns"] for r in rows if r["status"] == "matched")

    assert deltas(forth) == sorted(-d for d in deltas(back))
