"""Trace summaries, span trees and their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.ranking import sums_before
from spanforge.operators.trees import number_whole_traces
from spanforge.session import cut_lineage, drop_cut

WHOLE_SPANS = 100_000  # spans of a trace that are numbered in one task


def trace_groups(traces: DataFrame) -> DataFrame:
    """One row per trace: its root (or earliest) span, span count and total duration.

    A single aggregate with map-side combine, so a huge trace is reduced before the shuffle.
    """
    is_child = F.when(F.col("parent_span_id") == "", 0).otherwise(1)
    root = F.min_by(
        F.struct("service_name", "span_name", F.col("start_time_unix_nano").alias("start")),
        F.struct(is_child, "start_time_unix_nano", "span_id"),
    )
    end = F.col("start_time_unix_nano") + F.col("duration_ns")
    return (
        traces.groupBy("trace_id")
        .agg(
            root.alias("root"),
            F.count("*").alias("span_count"),
            F.min("start_time_unix_nano").alias("first"),
            F.max(end).alias("last"),
        )
        .select(
            "trace_id",
            F.col("root.service_name").alias("service_name"),
            F.col("root.span_name").alias("root_span_name"),
            "span_count",
            F.greatest(F.col("last") - F.col("first"), F.lit(0)).alias("duration_ns"),
            F.col("root.start").alias("start_time_unix_nano"),
        )
    )


def in_group_order(groups: DataFrame) -> DataFrame:
    """Trace summaries, oldest root first."""
    return groups.orderBy("start_time_unix_nano", "trace_id")


_IDENTITY = ["na", "nb", "ua", "ub", "start"]


def _key(trace_id: Column, span_id: Column, first: str, second: str) -> list[Column]:
    """Two longs for a span id inside its trace: 128 bits, cheaper to join on than the texts."""
    return [
        F.xxhash64(trace_id, span_id).alias(first),
        F.xxhash64(F.lit(1), trace_id, span_id).alias(second),
    ]


def _positions(traces: DataFrame) -> DataFrame:
    """Distinct tree positions: own key ``na, nb``, parent's key ``ua, ub``, what orders siblings.

    All roots of a trace have one key above them, that of the empty parent id.
    """
    trace = F.col("trace_id")
    return traces.select(
        *_key(trace, F.lit(""), "ta", "tb"),
        *_key(trace, F.col("span_id"), "na", "nb"),
        *_key(trace, F.col("parent_span_id"), "ua", "ub"),
        F.col("start_time_unix_nano").alias("start"),
        "span_id",
    ).distinct()


def _with_tops(positions: DataFrame) -> DataFrame:
    """Append ``top``: roots, and the earliest span of a trace that has none."""
    is_root = (F.col("ua") == F.col("ta")) & (F.col("ub") == F.col("tb"))
    rootless = (
        positions.groupBy("ta", "tb").agg(F.max(is_root).alias("_rooted"))
        .where(~F.col("_rooted")).drop("_rooted")
    )
    if rootless.isEmpty():
        return positions.withColumn("top", is_root)
    earliest = (
        positions.join(rootless, ["ta", "tb"], "left_semi")
        .groupBy("ta", "tb")
        .agg(F.min(F.struct("start", "span_id")).alias("_first"))
    )
    first = F.struct("start", "span_id") == F.col("_first")
    return positions.join(earliest, ["ta", "tb"], "left").withColumn(
        "top", is_root | F.coalesce(first, F.lit(False))
    ).drop("_first")


def _parents(nodes: DataFrame) -> DataFrame:
    """The positions that have children, with the number of these as ``below``.

    Of several positions with one id the earliest has them.
    """
    children = (
        nodes.where(~F.col("top")).groupBy("ua", "ub").agg(F.count("*").alias("below"))
        .select(F.col("ua").alias("na"), F.col("ub").alias("nb"), "below")
    )
    earliest = nodes.groupBy("na", "nb").agg(
        F.min(F.struct("start", "ua", "ub", "top")).alias("_n")
    )
    return earliest.join(children, ["na", "nb"]).select("na", "nb", "_n.*", "below")


def _doubled(state: DataFrame, sums: list[str], flags: list[str], collect: str | None) -> DataFrame:
    """Follow the pointers ``ua, ub`` (NULL at the end) of every row to the end of its chain.

    Each round a row takes over the pointer of the row that it points at and adds that row's
    ``sums`` (numbers) and ``flags``, so a chain of n rows is done in about log2(n) rounds and
    the state stays one row for each. ``collect`` names a number that goes the other way: a row
    adds those of all rows that point at it, and ends with the total of all below it. A round in
    which no row ends proves that only cycles are left; their rows are dropped.
    """
    own = ["na", "nb", *sums, *flags, *([collect] if collect else [])]
    state = cut_lineage(state.select(*own, "ua", "ub"))
    open_before = None
    while True:
        pending = state.where(F.col("ua").isNotNull())
        left = pending.count()
        if left == 0 or left == open_before:
            return state.where(F.col("ua").isNull()).drop("ua", "ub")
        open_before = left
        ahead = state.select(
            F.col("na").alias("ua"), F.col("nb").alias("ub"),
            F.struct("ua", "ub", *sums, *flags).alias("_ahead"),
        )
        stepped = state.join(ahead, ["ua", "ub"], "left")
        columns = [
            *(F.col(c) + F.coalesce(F.col(f"_ahead.{c}"), F.lit(0)) for c in sums),
            *(F.col(c) | F.coalesce(F.col(f"_ahead.{c}"), F.lit(False)) for c in flags),
        ]
        named = [c.alias(n) for c, n in zip(columns, [*sums, *flags], strict=True)]
        if collect:
            under = pending.groupBy("ua", "ub").agg(F.sum(collect).alias("_under"))
            under = under.withColumnsRenamed({"ua": "na", "ub": "nb"})
            stepped = stepped.join(under, ["na", "nb"], "left")
            named.append((F.col(collect) + F.coalesce("_under", F.lit(0))).alias(collect))
        after = cut_lineage(stepped.select(
            "na", "nb", *named, F.col("_ahead.ua").alias("ua"), F.col("_ahead.ub").alias("ub")
        ))
        drop_cut(state)
        state = after


def span_tree(traces: DataFrame, keep_orphans: bool = False) -> DataFrame:
    """Every span below a root with ``depth``, ``position`` and ``subtree_size``.

    ``position`` numbers the spans of a trace from 0 in depth-first order, children by start
    time and then id; ``subtree_size`` counts a span and all below it, so a subtree is the range
    of positions ``position`` to ``position + subtree_size - 1``. A trace without any root takes
    its earliest span as one; spans under a missing parent are dropped unless ``keep_orphans``
    makes them further roots, flagged ``orphan``. When several spans share an id, children hang
    under the earliest of them. Copies of a span share a position. Cycles are dropped.

    Traces of at most ``WHOLE_SPANS`` spans are dealt out by trace once and numbered in Arrow
    batches. Of larger ones there are fewer than one in ``WHOLE_SPANS`` spans; they are told apart by
    a broadcast and numbered by pointer doubling, in no single task. All columns of ``traces`` travel
    along, so leave out those that are not needed.
    """
    large = cut_lineage(
        traces.groupBy(F.col("trace_id").alias("_trace")).agg(F.count("*").alias("_spans"))
        .where(F.col("_spans") > WHOLE_SPANS).select("_trace")
    )
    if large.isEmpty():
        return number_whole_traces(traces, keep_orphans)
    is_large = F.col("trace_id").eqNullSafe(F.col("_trace"))
    small = traces.join(F.broadcast(large), is_large, "left_anti")
    rest = traces.join(F.broadcast(large), is_large, "left_semi")
    return number_whole_traces(small, keep_orphans).unionByName(_large_trees(rest, keep_orphans))


def _large_trees(traces: DataFrame, keep_orphans: bool) -> DataFrame:
    """:func:`span_tree` of traces of any size, spread over tasks.

    Only spans with children are followed up the tree, by pointer doubling in about log2(depth)
    rounds, once for depths and subtree sizes and once for positions: a span lies behind its
    parent and the subtrees of its earlier siblings. All state is a few numbers for each span,
    checkpointed to the shared folder; sums over siblings are split by ranges, so a span with very
    many children is no single task.
    """
    nodes = _with_tops(cut_lineage(_positions(traces)))
    parents = _parents(nodes)
    known = parents.select(
        F.col("na").alias("ua"), F.col("nb").alias("ub"), F.lit(True).alias("_known")
    )
    pointed = cut_lineage(parents.join(known, ["ua", "ub"], "left"))
    up_known = F.col("top") | F.coalesce("_known", F.lit(False))
    ends = ~up_known | F.col("top")
    inner = _doubled(
        pointed.select(
            "na", "nb",
            F.when(~ends, F.col("ua")).alias("ua"), F.when(~ends, F.col("ub")).alias("ub"),
            F.when(ends, 0).otherwise(1).alias("depth"), "below",
            (~up_known).alias("orphan"),
        ),
        ["depth"], ["orphan"], "below",
    )
    if not keep_orphans:
        inner = inner.where(~F.col("orphan"))
    inner = cut_lineage(inner)

    # Every position beside what is above it (NULL for tops) and below it.
    above = inner.select(
        F.col("na").alias("ua"), F.col("nb").alias("ub"),
        F.struct("depth", "orphan").alias("_above"),
    )
    first_of_id = parents.select("na", "nb", "start", "ua", "ub", F.lit(True).alias("_first"))
    beside = nodes.join(first_of_id, _IDENTITY, "left").join(
        inner.select("na", "nb", "below"), ["na", "nb"], "left"
    ).join(above, ["ua", "ub"], "left")
    orphan_here = ~F.col("top") & F.col("_above").isNull()
    if keep_orphans:  # a cycle has a parent, an orphan has none
        ids = nodes.select(F.col("na").alias("ua"), F.col("nb").alias("ub")).distinct()
        beside = beside.join(ids.withColumn("_id", F.lit(True)), ["ua", "ub"], "left")
        orphan_here = orphan_here & F.col("_id").isNull()
        beside = beside.where(F.col("top") | F.col("_above").isNotNull() | orphan_here)
    else:
        beside = beside.where(F.col("top") | F.col("_above").isNotNull())
        orphan_here = F.lit(False)
    is_top = F.col("top") | orphan_here
    below = F.when(F.col("_first"), F.col("below")).otherwise(None)
    placed = cut_lineage(beside.select(
        *_IDENTITY, "span_id",
        F.when(is_top, F.col("ta")).otherwise(F.col("ua")).alias("sa"),
        F.when(is_top, F.col("tb")).otherwise(F.col("ub")).alias("sb"),
        F.when(is_top, 0).otherwise(F.col("_above.depth") + 1).alias("depth"),
        F.when(is_top, orphan_here).otherwise(F.col("_above.orphan")).alias("orphan"),
        (F.coalesce(below, F.lit(0)) + 1).alias("subtree_size"),
        is_top.alias("_top"), F.coalesce("_first", F.lit(False)).alias("_first"),
    ))
    placed = sums_before(placed, ["sa", "sb"], ["start", "span_id", "ua", "ub"], "subtree_size", "_before")
    placed = cut_lineage(placed.withColumn(
        "_offset", F.col("_before") + F.when(F.col("_top"), 0).otherwise(1)
    ))
    begins = _doubled(
        placed.where("_first").select(
            "na", "nb", F.col("_offset").alias("_begin"),
            F.when(~F.col("_top"), F.col("ua")).alias("ua"),
            F.when(~F.col("_top"), F.col("ub")).alias("ub"),
        ),
        ["_begin"], [], None,
    )
    parent_begins = begins.select(
        F.col("na").alias("sa"), F.col("nb").alias("sb"), F.col("_begin").alias("_parent_begin")
    )
    numbered = placed.join(parent_begins, ["sa", "sb"], "left").select(
        *_IDENTITY, "depth", "orphan", "subtree_size",
        (F.col("_offset") + F.when(F.col("_top"), 0).otherwise(F.col("_parent_begin"))).alias("position"),
    )
    trace = F.col("trace_id")
    keyed = traces.select(
        "*", *_key(trace, F.col("span_id"), "na", "nb"),
        *_key(trace, F.col("parent_span_id"), "ua", "ub"),
        F.col("start_time_unix_nano").alias("start"),
    )
    return keyed.join(numbered, _IDENTITY).select(
        *traces.columns, "depth", "position", "subtree_size", "orphan"
    )


def in_tree_order(tree: DataFrame) -> DataFrame:
    """Depth-first order; a range-partitioned sort, so a huge trace spreads over tasks."""
    return tree.orderBy("trace_id", "position")


def waterfall_layout(traces: DataFrame) -> DataFrame:
    """Left edge and width of every span in percent of its trace's time range."""
    end = F.col("start_time_unix_nano") + F.col("duration_ns")
    bounds = traces.groupBy("trace_id").agg(
        F.min("start_time_unix_nano").alias("_min"), F.max(end).alias("_max")
    )
    span = F.when(F.col("_max") == F.col("_min"), 1).otherwise(F.col("_max") - F.col("_min"))
    span = span.cast("double")
    left = (F.col("start_time_unix_nano") - F.col("_min")).cast("double") / span * 100
    width = F.col("duration_ns").cast("double") / span * 100
    return (
        traces.join(bounds, "trace_id")
        .withColumn("left_pct", left)
        .withColumn("width_pct", F.greatest(F.lit(0.5), width))
        .drop("_min", "_max")
    )


def display_rows(extended: DataFrame) -> DataFrame:
    """Span rows for display: shown service, times and durations as text, list sizes."""
    return extended.select(
        T.format_time_of_day(F.col("start_time_unix_nano")).alias("time"),
        T.display_service(F.col("service_name")).alias("service"),
        "span_name",
        T.format_duration(F.col("duration_ns")).alias("duration"),
        T.span_kind_name(F.col("kind")).alias("kind"),
        T.status_name(F.col("status_code")).alias("status"),
        "trace_id",
        "span_id",
        "events_count",
        "links_count",
    )
