"""Join of points in time with the intervals of their key that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits between two widths of buckets: a bucket is less than eight times as wide as its intervals.
STEP = 3
TOP = 63


def _level(length: Column) -> Column:
    """The smallest width, as a power of two, that is a multiple of ``STEP`` and holds the length."""
    bits = F.length(F.bin(length))
    return F.least(F.ceil(bits / STEP) * STEP, F.lit(TOP)).cast("int")


def _bucket(at: Column, level: Column) -> Column:
    """Number of the bucket of width ``2^level`` that holds a time; floors for negative ones."""
    return F.call_function("shiftright", at, level)


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str
) -> DataFrame:
    """Every point with every interval of equal keys that holds it, both ends included.

    An interval lies in one or two buckets of time of about its own length; a point looks into one
    bucket for each length that its key has, 21 at most. Candidates are so bounded by the points
    near an interval, however many the key has. The join is on keys, length and bucket: a key
    with a third of all rows is dealt out by time, and Spark splits what is still too large.

    Null keys, times or ends match nothing, nor do intervals that end before they begin; repeated
    rows match each. ``points`` and ``intervals`` share no column names but the keys.
    """
    sized = intervals.where(F.col(begin) <= F.col(end)).withColumn(
        "_level", _level(F.try_subtract(F.col(end), F.col(begin)))
    )
    # A difference beyond a long lies in the widest buckets, of which there are two.
    sized = sized.withColumn("_level", F.coalesce("_level", F.lit(TOP)))
    first, last = (_bucket(F.col(c), F.col("_level")) for c in (begin, end))
    dealt = sized.withColumn("_bucket", F.explode(F.sequence(first, last)))
    lengths = sized.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    asking = (
        points.join(lengths, keys)
        .withColumn("_level", F.explode("_levels"))
        .withColumn("_bucket", _bucket(F.col(at), F.col("_level")))
        .drop("_levels")
    )
    return (
        asking.join(dealt, [*keys, "_level", "_bucket"])
        .where((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end)))
        .drop("_level", "_bucket")
    )


def logs_in_spans(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Log records with each span of their trace that was open at the time of the record.

    ``trace_id``, time, severity, service and body of the record, id and name of the span, and the
    nanoseconds since its start.
    """
    points = logs.where(F.col("trace_id") != "").select(
        "trace_id", "timestamp_unix_nano", "severity_number", "body",
        F.col("service_name").alias("log_service"),
    )
    spans = traces.select(
        "trace_id", F.col("span_id").alias("inside_span_id"), "span_name",
        "start_time_unix_nano", "end_time_unix_nano",
    )
    held = points_in_intervals(
        points, spans, ["trace_id"], "timestamp_unix_nano", "start_time_unix_nano", "end_time_unix_nano"
    )
    since = F.col("timestamp_unix_nano") - F.col("start_time_unix_nano")
    return held.withColumn("since_start_ns", since).drop("start_time_unix_nano", "end_time_unix_nano")
