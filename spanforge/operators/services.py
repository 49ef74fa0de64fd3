"""Service dependency map and its renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import numbers as N
from spanforge.functions.text import fixed
from spanforge.session import cut_lineage


def service_map(
    traces: DataFrame, since: int | None = None, match_trace: bool = True
) -> DataFrame:
    """Calls between services: caller, callee, calls and mean child duration in ms.

    Both sides are reduced to one row per id and service before they meet. A parent with very
    many children, or many copies of one span, therefore joins as a handful of rows with
    counts, and never as the product of its copies. ``match_trace=False`` joins on the span id
    alone.
    """
    if since is not None:
        traces = traces.where(F.col("start_time_unix_nano") >= since)
    ids = ["trace_id", "_id"] if match_trace else ["_id"]
    children = (
        traces.where(F.col("parent_span_id") != "")
        .withColumnRenamed("parent_span_id", "_id")
        .groupBy(*ids, F.col("service_name").alias("callee_service"))
        .agg(
            F.count("*").alias("_n"),
            F.sum(N.high(F.col("duration_ns"))).alias("_high"),
            F.sum(N.low(F.col("duration_ns"))).alias("_low"),
        )
    )
    parents = (
        traces.drop("_id").withColumnRenamed("span_id", "_id")
        .groupBy(*ids, F.col("service_name").alias("caller_service"))
        .agg(F.count("*").alias("_copies"))
    )
    return (
        parents.join(children, ids)
        .where(F.col("caller_service") != F.col("callee_service"))
        .groupBy("caller_service", "callee_service")
        .agg(
            F.sum(F.col("_n") * F.col("_copies")).alias("call_count"),
            N.joined(
                F.sum(F.col("_high") * F.col("_copies")), F.sum(F.col("_low") * F.col("_copies"))
            ).alias("_total_ns"),
        )
        .withColumn(
            "avg_duration_ms",
            F.col("_total_ns").cast("double") / F.col("call_count").cast("double") / 1e6,
        )
        .drop("_total_ns")
    )


def in_call_order(edges: DataFrame) -> DataFrame:
    """Most calls first."""
    return edges.orderBy(F.col("call_count").desc(), "caller_service", "callee_service")


def mermaid_id(name: Column) -> Column:
    """Letters, digits and ``_`` only."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


_LINE_ORDER = ["section", "sort_calls", "caller_service", "callee_service"]


def _lines(df: DataFrame, section: int, line: Column) -> DataFrame:
    edge = "call_count" in df.columns
    none = F.lit("")
    return df.select(
        F.lit(section).alias("section"),
        (-F.col("call_count") if edge else F.lit(0)).cast("bigint").alias("sort_calls"),
        (F.col("caller_service") if edge else none).alias("caller_service"),
        (F.col("callee_service") if edge else none).alias("callee_service"),
        line.alias("line"),
    )


def _fixed_line(edges: DataFrame, section: int, text: str) -> DataFrame:
    # An aggregate over the edges: one line exactly when there is an edge.
    present = edges.agg(F.count("*").alias("_n")).where(F.col("_n") > 0)
    return _lines(present, section, F.lit(text))


def in_line_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*_LINE_ORDER)


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """Mermaid flow chart as lines; sort with :func:`in_line_order`.

    The edges (one row per pair of services) are computed once and then rendered.
    """
    edges = cut_lineage(edges)
    caller, callee = F.col("caller_service"), F.col("callee_service")
    edge = F.concat(
        F.lit("    "), mermaid_id(caller), F.lit('["'), caller, F.lit('"] -->|'),
        F.col("call_count").cast("string"), F.lit(" calls, "),
        fixed(F.col("avg_duration_ms"), 1), F.lit("ms avg| "),
        mermaid_id(callee), F.lit('["'), callee, F.lit('"]'),
    )
    return _fixed_line(edges, 0, "graph LR").unionByName(_lines(edges, 1, edge))


def text_lines(edges: DataFrame) -> DataFrame:
    """Plain text map as lines: title, one line per edge, then the services in order."""
    edges = cut_lineage(edges)
    title = "Service Dependency Map"
    edge = F.concat(
        F.lit("  "), F.col("caller_service"), F.lit(" --("),
        F.col("call_count").cast("string"), F.lit(" calls, avg "),
        fixed(F.col("avg_duration_ms"), 1), F.lit("ms)--> "),
        F.col("callee_service"),
    )
    # The set of service names is the size of the printed line itself.
    names = edges.select(
        F.explode(F.array("caller_service", "callee_service")).alias("name")
    ).agg(F.array_sort(F.collect_set("name")).alias("names"))
    services = _lines(
        names.where(F.size("names") > 0),
        3,
        F.concat(F.lit("Services: "), F.array_join("names", ", ")),
    )
    return (
        _fixed_line(edges, 0, title)
        .unionByName(_fixed_line(edges, 1, "=" * len(title)))
        .unionByName(_lines(edges, 2, edge))
        .unionByName(services)
    )
