"""Metric roll-ups, display values and down-sampled series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.ranking import pick_ranks

SERIES = ["metric_name", "service_name"]
MIN_SERIES_POINTS = 5


def value_text(points: DataFrame) -> Column:
    """Display text of one point: integers plain, doubles with six digits, else count and sum."""
    number = (
        F.when(~F.col("has_value"), "")
        .when(F.col("is_int"), F.col("value").cast("bigint").cast("string"))
        .otherwise(F.format_string("%.6f", F.col("value")))
    )
    spread = F.format_string(
        "count=%d sum=%.3f", F.col("point_count"), F.coalesce(F.col("point_sum"), F.lit(0.0))
    )
    return F.when(F.col("metric_type").isin("gauge", "sum"), number).otherwise(spread)


def metric_rollup(points: DataFrame) -> DataFrame:
    """One row per metric and service, from ``flatten_metrics(..., extended=True)``.

    Type and newest value come from the newest point, unit and description from the oldest.
    Points are not gathered into a list: :func:`series_points` gives them as ordered rows.
    """
    is_point = F.col("metric_type") != "unknown"
    when = F.col("timestamp_unix_nano")
    kind = F.when(F.col("metric_type") == "exponential_histogram", "exp_histogram").otherwise(
        F.col("metric_type")
    )
    shown = points.select(
        "metric_name",
        T.display_service(F.col("service_name")).alias("service_name"),
        kind.alias("metric_type"),
        "unit",
        "description",
        when,
        "value",
        "is_int",
        "has_value",
        is_point.alias("_is_point"),
        value_text(points).alias("_text"),
    )
    is_point = F.col("_is_point")
    newest = F.struct("timestamp_unix_nano", "value", "_text")
    return shown.groupBy(*SERIES).agg(
        F.max_by("metric_type", F.struct("_is_point", when, "metric_type")).alias("metric_type"),
        F.min_by("unit", F.struct(when, "unit")).alias("unit"),
        F.min_by("description", F.struct(when, "description")).alias("description"),
        F.count(F.when(is_point, 1)).alias("point_count"),
        F.max(F.when(is_point, when)).alias("newest_unix_nano"),
        F.max_by("value", F.when(is_point, newest)).alias("newest_value"),
        F.max_by("_text", F.when(is_point, newest)).alias("newest_text"),
        F.sum(F.when(is_point, F.col("value"))).alias("total"),
        F.coalesce(F.bool_and(F.when(is_point, F.col("is_int"))), F.lit(False)).alias("all_int"),
        F.coalesce(F.bool_and(F.when(is_point, F.col("has_value"))), F.lit(False)).alias(
            "all_have_value"
        ),
    )


def with_display_value(rollup: DataFrame) -> DataFrame:
    """Adds ``display_value`` (text) and ``display_number``.

    No point shows ``-``, one point its value, several points of a gauge or sum their total,
    anything else the newest value.
    """
    summable = (
        (F.col("point_count") > 1)
        & F.col("metric_type").isin("gauge", "sum")
        & F.col("all_have_value")
    )
    total = F.when(F.col("all_int"), F.col("total").cast("bigint").cast("string")).otherwise(
        F.format_string("%.6f", F.col("total"))
    )
    return rollup.withColumn(
        "display_value",
        F.when(F.col("point_count") == 0, "-")
        .when(summable, total)
        .otherwise(F.col("newest_text")),
    ).withColumn(
        "display_number",
        F.when(F.col("point_count") == 0, None)
        .when(summable, F.col("total"))
        .otherwise(F.col("newest_value")),
    )


def series_points(points: DataFrame) -> DataFrame:
    """Data points as rows, newest first inside each metric and service."""
    return points.where(F.col("metric_type") != "unknown").orderBy(
        *SERIES, F.col("timestamp_unix_nano").desc(), "value"
    )


def metric_series(metrics: DataFrame, width: int) -> DataFrame:
    """Gauge and sum series in time order, thinned to ``width`` evenly spaced points.

    Position i shows point ``i * (n - 1) div (width - 1)`` of n; shorter series are shown whole
    and series under five points not at all. ``normalized`` is the height between the series'
    minimum and maximum. The picked points are found by counting, not by ordering a series in
    one task.
    """
    if width < 2:
        raise ValueError("a series needs a width of at least 2")
    rows = metrics.where(
        F.col("metric_type").isin("gauge", "sum") & F.col("value").isNotNull()
    ).select(*SERIES, "timestamp_unix_nano", "value")
    steps = F.lit(width - 1).cast("bigint")

    def first_position(rank: Column, total: Column) -> Column:
        # Smallest i with i * (total - 1) div steps >= rank.
        gaps = F.when(total > 1, total - 1).otherwise(1)
        return F.call_function("div", rank * steps + gaps - 1, gaps)

    def positions(first: Column, end: Column, total: Column) -> tuple[Column, Column]:
        whole = total <= width
        low = F.when(whole, first).otherwise(first_position(first, total))
        high = F.when(whole, end).otherwise(first_position(end, total))
        limit = F.when(whole, total).otherwise(F.lit(width))
        return low, F.least(high, limit.cast("bigint"))

    def wanted(first: Column, end: Column, total: Column) -> Column:
        low, high = positions(first, end, total)
        return (total >= MIN_SERIES_POINTS) & (low < high)

    picked = pick_ranks(rows, SERIES, "timestamp_unix_nano", wanted, ["value"])
    low, high = positions(F.col("rank_first"), F.col("rank_end"), F.col("total"))
    placed = picked.select(
        *SERIES,
        "timestamp_unix_nano",
        "value",
        F.col("total").alias("points"),
        F.explode(F.sequence(low, high - 1)).alias("position"),
    )
    bounds = rows.groupBy(*SERIES).agg(
        F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    height = (F.col("value") - F.col("_min")) / F.greatest(
        F.col("_max") - F.col("_min"), F.lit(0.001)
    )
    return (
        placed.join(bounds, SERIES).withColumn("normalized", height).drop("_min", "_max")
    )
