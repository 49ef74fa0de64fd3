"""Span by span comparison of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.operators.ranking import ranks
from spanforge.session import cut_lineage

PAIR_ID = "pair_id"
WHOLE_SPANS = 100_000  # spans of a pair that are ranked in one task


def one_pair(traces: DataFrame, trace_a: str, trace_b: str) -> DataFrame:
    """A pair table of one row, to compare two known traces."""
    return traces.sparkSession.range(1).select(
        (F.col("id") + 1).alias(PAIR_ID),
        F.lit(trace_a).alias("trace_a"),
        F.lit(trace_b).alias("trace_b"),
    )


def _sides(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Spans of both traces of every pair, tagged with pair and side."""
    sides = pairs.select(
        PAIR_ID,
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("trace_a").alias("trace_id")),
                F.struct(F.lit("b").alias("side"), F.col("trace_b").alias("trace_id")),
            )
        ).alias("s"),
    ).select(PAIR_ID, "s.side", "s.trace_id")
    return traces.join(sides, "trace_id")


def percent_change(a: Column, b: Column, when_zero: Column) -> Column:
    """Change from a to b in percent of a; ``when_zero`` stands in when a is 0."""
    base = F.when(a != 0, a.cast("double"))
    return F.when(a == 0, when_zero).otherwise((b - a).cast("double") / base * 100.0)


def _ranked_whole(spans: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start_time_unix_nano", "span_id")
    position = (F.row_number().over(order) - 1).cast("bigint").alias("position")
    return spans.repartition(F.col(PAIR_ID)).select("*", position)


def trace_diff(
    traces: DataFrame, pairs: DataFrame, threshold: float | None = None
) -> DataFrame:
    """Pair the i-th span of A with the i-th of B inside (service, span name).

    ``pairs`` has ``pair_id, trace_a, trace_b``, one row or many. Status is ``matched``,
    ``removed`` (only in A) or ``added`` (only in B). With a threshold, ``exceeds_threshold``
    marks matched spans whose change in percent is larger. Pairs of more than ``WHOLE_SPANS`` spans
    are ranked by ranges, spread over tasks; the others are dealt out by pair, once for both the
    ranks and the meeting of the sides.
    """
    keys = [PAIR_ID, "side", "service_name", "span_name"]
    spans = _sides(traces, pairs).select(
        *keys, "span_id", "start_time_unix_nano", "duration_ns"
    )
    large = cut_lineage(
        _sides(traces.select("trace_id"), pairs).groupBy(F.col(PAIR_ID).alias("_pair"))
        .agg(F.count("*").alias("_spans")).where(F.col("_spans") > WHOLE_SPANS).select("_pair")
    )
    if large.isEmpty():
        ranked = _ranked_whole(spans, keys)
    else:
        is_large = F.col(PAIR_ID).eqNullSafe(F.col("_pair"))
        rest = spans.join(large, is_large, "left_semi")
        ranked = _ranked_whole(spans.join(large, is_large, "left_anti"), keys).unionByName(
            ranks(rest, keys, "start_time_unix_nano", ["span_id"], out="position")
        )
    on = [PAIR_ID, "service_name", "span_name", "position"]

    # Both sides meet in one aggregate: a position holds at most one span of each side.
    def side(name: str) -> Column:
        span = F.struct("span_id", "start_time_unix_nano", "duration_ns")
        return F.max(F.when(F.col("side") == name, span)).alias(name)

    joined = (
        ranked.groupBy(*on)
        .agg(side("a"), side("b"))
        .select(
            *on,
            *[
                column
                for s in ("a", "b")
                for column in (
                    F.col(f"{s}.span_id").alias(f"span_id_{s}"),
                    F.col(f"{s}.start_time_unix_nano").alias(f"start_{s}"),
                    F.col(f"{s}.duration_ns").alias(f"duration_ns_{s}"),
                )
            ],
        )
    )
    a, b = F.col("duration_ns_a"), F.col("duration_ns_b")
    status = F.when(b.isNull(), "removed").when(a.isNull(), "added").otherwise("matched")
    matched = a.isNotNull() & b.isNotNull()
    zero = F.when(b == 0, 0.0).otherwise(100.0)
    out = joined.select(
        *on,
        status.alias("status"),
        "span_id_a",
        "span_id_b",
        "start_a",
        "start_b",
        "duration_ns_a",
        "duration_ns_b",
        F.when(matched, b - a).alias("delta_ns"),
        F.when(matched, percent_change(a, b, zero)).alias("pct_change"),
    )
    if threshold is not None:
        out = out.withColumn("exceeds_threshold", F.abs("pct_change") > threshold)
    return out


def in_diff_order(diff: DataFrame) -> DataFrame:
    """Matched spans by start in A, then removed, then added ones by start."""
    rank = F.when(F.col("status") == "matched", 0).when(F.col("status") == "removed", 1)
    return diff.orderBy(
        PAIR_ID,
        rank.otherwise(2),
        F.coalesce("start_a", "start_b"),
        F.coalesce("span_id_a", "span_id_b"),
    )


def trace_diff_summary(
    traces: DataFrame, pairs: DataFrame, threshold: float | None = None
) -> DataFrame:
    """Total durations of both traces of every pair, their change, and missing traces.

    A missing trace counts as empty, with total 0, and is flagged in ``missing_a`` or
    ``missing_b``.
    """
    end = F.col("start_time_unix_nano") + F.col("duration_ns")
    in_a, in_b = F.col("side") == "a", F.col("side") == "b"

    def total(side: Column) -> Column:
        span = F.max(F.when(side, end)) - F.min(F.when(side, F.col("start_time_unix_nano")))
        return F.greatest(F.coalesce(span, F.lit(0)), F.lit(0))

    sums = (
        _sides(traces, pairs)
        .groupBy(PAIR_ID)
        .agg(
            total(in_a).alias("total_ns_a"),
            total(in_b).alias("total_ns_b"),
            F.count(F.when(in_a, 1)).alias("_spans_a"),
            F.count(F.when(in_b, 1)).alias("_spans_b"),
        )
    )
    a = F.coalesce(F.col("total_ns_a"), F.lit(0))
    b = F.coalesce(F.col("total_ns_b"), F.lit(0))
    pct = percent_change(a, b, F.lit(0.0))
    out = pairs.select(PAIR_ID, "trace_a", "trace_b").join(sums, PAIR_ID, "left").select(
        PAIR_ID,
        "trace_a",
        "trace_b",
        a.alias("total_ns_a"),
        b.alias("total_ns_b"),
        (b - a).alias("delta_ns"),
        pct.alias("pct_change"),
        (F.coalesce("_spans_a", F.lit(0)) == 0).alias("missing_a"),
        (F.coalesce("_spans_b", F.lit(0)) == 0).alias("missing_b"),
    )
    if threshold is not None:
        out = out.withColumn("exceeds_threshold", F.abs("pct_change") > threshold)
    return out
