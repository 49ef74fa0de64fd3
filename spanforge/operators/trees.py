"""Numbering of the spans of whole traces in Arrow batches, many traces at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 1 << 16  # rows looked at together, more only where a single trace has more
ORDER = ["trace_id", "start_time_unix_nano", "span_id", "parent_span_id"]


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    out[:1] = True
    return out


def parents(trace: np.ndarray, span: np.ndarray, parent: np.ndarray, start: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of every position's parent (-1 for none), and whether the position is a top of its trace.

    Positions come in the order of ``ORDER``, each once; of several with one id the first has children.
    """
    begins = _changes(trace)
    number = np.cumsum(begins) - 1
    at = np.flatnonzero(begins)
    root = parent == empty
    rooted = np.logical_or.reduceat(root, at)[number]
    head = at[number]
    top = root | (~rooted & (start == start[head]) & (span == span[head]))
    width = int(max(span.max(), parent.max())) + 1
    keys, first = np.unique(number * width + span, return_index=True)
    wanted = number * width + parent
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(~top & (keys[found] == wanted), first[found], -1), top


def numbers(above: np.ndarray, roots: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth (-1 where no root is reached), depth-first position and subtree size, level by level.

    ``group`` tells the trace of every row; siblings and the roots of a trace come in their order.
    """
    n = len(above)
    child = np.flatnonzero(above >= 0)
    child = child[np.argsort(above[child], kind="stable")]
    many = np.bincount(above[child], minlength=n)
    begin = np.cumsum(many) - many
    levels = [roots]
    while True:
        last = levels[-1]
        last = last[many[last] > 0]
        if not len(last):
            break
        size = many[last]
        ends = np.cumsum(size)
        levels.append(child[np.repeat(begin[last] - ends + size, size) + np.arange(ends[-1])])
    depth, position, below = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(below, above[level], below[level])
    for i, level in enumerate(levels):
        depth[level] = i
        before = np.cumsum(below[level]) - below[level]
        new = _changes(above[level] if i else group[level])
        before -= np.maximum.accumulate(np.where(new, before, 0))
        position[level] = before + (position[above[level]] + 1 if i else 0)
    return depth, position, below


def _numbered(rows: pa.Table, keep_orphans: bool) -> pa.Table:
    trace, start = (_codes(rows.column(c).combine_chunks()) for c in ("trace_id", "start_time_unix_nano"))
    ids = [rows.column(c).combine_chunks() for c in ("span_id", "parent_span_id")]
    both = _codes(pa.concat_arrays([*ids, pa.array([""], ids[0].type)]))
    span, parent, empty = both[: len(rows)], both[len(rows) : -1], both[-1]
    new = _changes(trace, start, span, parent)
    place, own = np.cumsum(new) - 1, np.flatnonzero(new)
    above, top = parents(trace[own], span[own], parent[own], start[own], empty)
    roots = np.flatnonzero(above < 0 if keep_orphans else top)
    depth, position, below = numbers(above, roots, trace[own])
    # A top goes before what is below it, so an orphan is told by the top that its chain ends in.
    orphan = np.zeros(len(own), bool)
    if keep_orphans:
        orphan = (above < 0) & ~top
        for d in range(1, int(depth.max(initial=0)) + 1) if orphan.any() else ():
            at = np.flatnonzero(depth == d)
            orphan[at] = orphan[above[at]]
    kept = np.flatnonzero(depth[place] >= 0)
    place = place[kept]
    out = rows.take(pa.array(kept)) if len(kept) < len(rows) else rows
    for name, values in (("depth", depth), ("position", position), ("subtree_size", below), ("orphan", orphan)):
        out = out.append_column(name, pa.array(values[place]))
    return out


def whole_traces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches in order of ``trace_id`` as tables of about ``rows`` rows that end where a trace does."""
    held: list[pa.RecordBatch] = []
    count, most = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        table = pa.Table.from_batches(held)
        ends = np.flatnonzero(_changes(_codes(table.column("trace_id").combine_chunks())))
        cut = int(ends[-1])
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).to_batches(), len(table) - cut
        most = max(rows, 2 * count)
    if held:
        yield pa.Table.from_batches(held)


def number_whole_traces(traces: DataFrame, keep_orphans: bool) -> DataFrame:
    """``traces`` with ``depth, position, subtree_size, orphan``, each trace within one task."""
    rows = ROWS

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_traces(batches, rows):
            yield from _numbered(table, keep_orphans).to_batches()

    added = {"depth": IntegerType(), "position": LongType(), "subtree_size": LongType(), "orphan": BooleanType()}
    shape = StructType([*traces.schema.fields, *[StructField(c, kind) for c, kind in added.items()]])
    ordered = traces.repartition(F.col("trace_id")).sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(number, shape)
