"""The counting helpers against brute force, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from spanforge.operators.ranking import counts_before, pick_ranks, ranks, sums_before


def skewed(spark, seed=3, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        at = rng.choice([0, 5, 5, rng.randrange(1 << 45), rng.randrange(1 << 22)])
        rows.append((key, at, f"{i:05d}"))
    return rows, spark.createDataFrame(rows, "k string, at bigint, id string")


def test_counts_before(spark):
    rows, df = skewed(spark)
    probes = [(k, at + d, d) for k, at, _ in rows[:200] for d in (-1, 0, 1)]
    got = counts_before(
        df.withColumn("weight", F.lit(2).cast("bigint")),
        spark.createDataFrame(probes, "k string, at bigint, d int"),
        ["k"],
    ).collect()
    assert len(got) == len(probes)
    for r in got:
        assert r["before"] == 2 * sum(1 for k, at, _ in rows if k == r["k"] and at < r["at"])


def test_ranks(spark):
    rows, df = skewed(spark, seed=5)
    ranked = ranks(df, ["k"], "at", ["id"])
    got = {(r["k"], r["id"]): r["rank"] for r in ranked.collect()}
    for key in {k for k, _, _ in rows}:
        ordered = sorted((at, i) for k, at, i in rows if k == key)
        for position, (_, i) in enumerate(ordered):
            assert got[(key, i)] == position


def test_pick_ranks_with_ties(spark):
    rows, df = skewed(spark, seed=7)

    def wanted(first, end, total):
        target = F.call_function("div", total, F.lit(2))
        return (target >= first) & (target < end)

    got = {r["k"]: (r["at"], r["id"], r["rank_first"], r["total"])
           for r in pick_ranks(df, ["k"], "at", wanted, ["id"]).collect()}
    for key in {k for k, _, _ in rows}:
        ordered = sorted((at, i) for k, at, i in rows if k == key)
        middle = len(ordered) // 2
        assert got[key] == (*ordered[middle], middle, len(ordered))


def test_negative_values_keep_their_order(spark):
    df = spark.createDataFrame([("k", v) for v in (-5, 3, -(1 << 50), 0)], "k string, v bigint")
    every = pick_ranks(df, ["k"], "v", lambda first, end, total: total > 0)
    assert [r["v"] for r in every.orderBy("rank_first").collect()] == [-(1 << 50), -5, 0, 3]


def test_a_million_rows_of_one_value(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).selectExpr(
        "'k' AS k", "7L AS at", "lpad(cast((id * 7919) % 1000000 AS string), 7, '0') AS id"
    )
    place = n * 2 // 3

    def wanted(first, end, total):
        return (F.lit(place) >= first) & (F.lit(place) < end)

    (row,) = pick_ranks(df, ["k"], "at", wanted, ["id"]).collect()
    assert (row["id"], row["rank_first"], row["total"]) == (f"{place:07d}", place, n)

    ranked = ranks(df, ["k"], "at", ["id"])
    wrong = ranked.where(F.col("rank") != F.col("id").cast("bigint"))
    assert ranked.count() == n and wrong.isEmpty()


def test_one_key_is_ordered_in_several_tasks(spark):
    df = spark.range(200_000, numPartitions=8).selectExpr("id % 1 AS k", "cast(id AS string) AS id", "1L AS w")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # few rows would be put together in one task
    try:
        summed = sums_before(df, ["k"], ["id"], "w", "before")
        sizes = [r["count"] for r in summed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(coalesce, before)
    assert len(sizes) > 1 and max(sizes) < 150_000
