"""Retention by count and by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.numbers import MAX_LONG
from spanforge.operators.ranking import pick_ranks
from spanforge.session import cut_lineage

def _row_at(wanted_rank: Column):
    def wanted(first: Column, end: Column, total: Column) -> Column:
        return (wanted_rank >= first) & (wanted_rank < end)

    return wanted


def retain_traces(
    spans: DataFrame,
    keep: int | Column,
    pins: DataFrame | None = None,
    arrival: str = "ingest_seq",
    new_from: int | Column | None = None,
) -> DataFrame:
    """Whole traces, newest first arrival first, until ``keep`` traces are held.

    Pinned traces (``pins`` has ``trace_id``) and those first seen at or after ``new_from``
    stay whatever the number; they count towards it. The spans are read once into a narrow
    table of arrivals; the oldest surviving trace is found in it by counting, so neither all
    traces nor the kept ones pass through one task. Spans that arrived before every trace kept
    by its age can only belong to a pinned one, so only the later ones meet all kept traces.
    """
    arrivals = spans.groupBy("trace_id").agg(F.min(arrival).cast("bigint").alias("first"))
    pinned = F.lit(False)
    if pins is not None:
        held = pins.select("trace_id", F.lit(True).alias("_pinned")).distinct()
        arrivals = arrivals.join(held, "trace_id", "left")
        pinned = F.coalesce(F.col("_pinned"), F.lit(False))
    safe = pinned if new_from is None else pinned | (F.col("first") >= new_from)
    arrivals = cut_lineage(
        arrivals.select(
            "trace_id", (F.lit(MAX_LONG) - F.col("first")).alias("age"), safe.alias("safe"),
            pinned.alias("pinned"), F.lit(0).alias("all"),
        )
    )
    # Rank of the last trace that still fits beside the safe ones.
    room = arrivals.where("safe").agg((F.lit(keep) - F.count("*") - 1).alias("r")).scalar()
    others = arrivals.where(~F.col("safe"))
    last = pick_ranks(others, ["all"], "age", _row_at(room), ["trace_id"])
    cutoff = last.select(F.struct("age", "trace_id").alias("c")).scalar()
    fits = F.coalesce(F.struct("age", "trace_id") <= cutoff, room >= 0)
    kept = cut_lineage(arrivals.where(F.col("safe") | fits).select("trace_id", "age", "pinned"))
    oldest = kept.where(~F.col("pinned")).agg(
        F.coalesce(F.lit(MAX_LONG) - F.max("age"), F.lit(MAX_LONG))
    ).first()[0]
    at = F.col(arrival).cast("bigint")
    # IN is a filter, and so moves under the windows and joins that spans may come from; a join
    # would not. A span without an arrival may be of any trace.
    in_kept = F.col("trace_id").isin(kept.select("trace_id"))
    late = spans.where(((at >= oldest) | at.isNull()) & in_kept)
    if pins is None:
        return late
    stay = cut_lineage(kept.where("pinned").select("trace_id"))
    early = spans.where((at < oldest) & F.col("trace_id").isin(stay))
    return late.unionByName(early)


def retain_batches(records: DataFrame, keep: int, batch: str = "batch_id") -> DataFrame:
    """Records of the newest ``keep`` batches (logs and metrics leave by batch)."""
    if keep <= 0:
        return records.where(F.lit(False))
    batches = records.select(
        (F.lit(MAX_LONG) - F.col(batch).cast("bigint")).alias("age"), F.lit(0).alias("all")
    ).distinct()
    last = pick_ranks(batches, ["all"], "age", _row_at(F.lit(keep - 1)))
    oldest = last.select((F.lit(MAX_LONG) - F.col("age")).alias("b")).scalar()
    return records.where(F.coalesce(F.col(batch) >= oldest, F.lit(True)))


# --- pins -------------------------------------------------------------------------------------


def add_pins(pins: DataFrame, ids: DataFrame) -> DataFrame:
    return pins.select("trace_id").unionByName(ids.select("trace_id")).distinct()


def remove_pins(pins: DataFrame, ids: DataFrame) -> DataFrame:
    return pins.select("trace_id").join(ids.select("trace_id"), "trace_id", "left_anti")


def toggle_pins(pins: DataFrame, ids: DataFrame) -> DataFrame:
    """Pin what was not pinned, unpin what was."""
    both = (
        pins.select("trace_id", F.lit(1).alias("_n")).distinct()
        .unionByName(ids.select("trace_id", F.lit(1).alias("_n")).distinct())
    )
    return both.groupBy("trace_id").agg(F.count("*").alias("_n")).where("_n = 1").select("trace_id")


# --- age --------------------------------------------------------------------------------------


def retain_spans_by_age(
    traces: DataFrame, cutoff: int, pins: DataFrame | None = None
) -> DataFrame:
    """Spans that ended at or after the cutoff; ``pins`` keeps pinned traces whatever their age."""
    fresh = F.col("end_time_unix_nano") >= cutoff
    if pins is None:
        return traces.where(fresh)
    pinned = pins.select("trace_id", F.lit(True).alias("_pinned")).distinct()
    return (
        traces.join(pinned, "trace_id", "left")
        .where(fresh | F.coalesce(F.col("_pinned"), F.lit(False)))
        .drop("_pinned")
    )


def retain_logs_by_age(logs: DataFrame, cutoff: int) -> DataFrame:
    """Records with time at or after the cutoff; the observed time stands in for a zero time."""
    time = F.col("timestamp_unix_nano")
    if "observed_time_unix_nano" in logs.columns:
        observed = F.coalesce("observed_time_unix_nano", F.lit(0))
        time = F.when(time > 0, time).otherwise(observed)
    return logs.where(time >= cutoff)


def retain_metrics_by_age(metrics: DataFrame, cutoff: int) -> DataFrame:
    """Data points at or after the cutoff; metrics without points go."""
    return metrics.where(
        (F.col("metric_type") != "unknown") & (F.col("timestamp_unix_nano") >= cutoff)
    )


def _prune(scopes: str, items: str, keep) -> Column:
    """Scopes with only the kept items, without scopes left empty."""
    pruned = F.transform(
        F.col(scopes),
        lambda s: F.struct(s["scope"].alias("scope"), keep(s[items]).alias(items)),
    )
    return F.filter(pruned, lambda s: F.size(s[items]) > 0)


def retain_nested_traces_by_age(batches: DataFrame, cutoff: int) -> DataFrame:
    def keep(spans: Column) -> Column:
        return F.filter(spans, lambda s: s["end_time_unix_nano"] >= cutoff)

    return batches.withColumn("scope_spans", _prune("scope_spans", "spans", keep)).where(
        F.size("scope_spans") > 0
    )


def retain_nested_logs_by_age(batches: DataFrame, cutoff: int) -> DataFrame:
    def fresh(r: Column) -> Column:
        own = F.coalesce(r["time_unix_nano"], F.lit(0))
        return F.when(own > 0, own).otherwise(r["observed_time_unix_nano"]) >= cutoff

    def keep(records: Column) -> Column:
        return F.filter(records, fresh)

    return batches.withColumn("scope_logs", _prune("scope_logs", "log_records", keep)).where(
        F.size("scope_logs") > 0
    )


_METRIC_FIELDS = {
    "gauge": (),
    "sum": ("aggregation_temporality", "is_monotonic"),
    "histogram": (),
    "exponential_histogram": (),
    "summary": (),
}


def retain_nested_metrics_by_age(batches: DataFrame, cutoff: int) -> DataFrame:
    def pruned(metric: Column, kind: str, extra: tuple[str, ...]) -> Column:
        data = metric[kind]
        points = F.filter(data["data_points"], lambda dp: dp["time_unix_nano"] >= cutoff)
        body = F.struct(points.alias("data_points"), *[data[f].alias(f) for f in extra])
        return F.when(data.isNotNull(), body).alias(kind)

    def one(metric: Column) -> Column:
        return F.struct(
            *[metric[f].alias(f) for f in ("name", "description", "unit")],
            *[pruned(metric, kind, extra) for kind, extra in _METRIC_FIELDS.items()],
        )

    def has_points(metric: Column) -> Column:
        found = F.lit(False)
        for kind in _METRIC_FIELDS:
            size = F.coalesce(F.size(metric[kind]["data_points"]), F.lit(0))
            found = found | (size > 0)
        return found

    def keep(metrics: Column) -> Column:
        return F.filter(F.transform(metrics, one), has_points)

    return batches.withColumn("scope_metrics", _prune("scope_metrics", "metrics", keep)).where(
        F.size("scope_metrics") > 0
    )
