"""Fires with a silence after each, followed by chunks of a rule's hits in Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from spanforge.functions.numbers import MAX_LONG
from spanforge.operators.ranking import counts_before
from spanforge.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_HITS = 1 << 18  # hits of one rule looked at together


def _steps(at: np.ndarray, silence: int) -> tuple[np.ndarray, np.ndarray]:
    """For every hit of a sorted list, when its rule may fire again, and the first hit from then on."""
    free = np.minimum(at, MAX_LONG - silence) + silence
    return free, np.maximum(np.searchsorted(at, free), np.arange(1, len(at) + 1))


def _chunk(rule: pa.Scalar, at: np.ndarray, silence: int) -> pa.RecordBatch:
    """A stretch of a rule's hits, and where every hit that can be its first fire leads.

    Such a hit is the first one from the end of a silence on that began before the stretch.
    ``free`` is when the rule may fire again after the last fire that it causes in the stretch.
    """
    free, to = _steps(at, silence)
    last = np.where(to < len(at), to, np.arange(len(at)))
    while True:
        onward = last[last]
        if np.array_equal(onward, last):
            break
        last = onward
    entries = min(int(to[0]) + 1, len(at))
    lists = [pa.array([part], pa.list_(pa.int64())) for part in (at, at[:entries], free[last[:entries]])]
    return pa.RecordBatch.from_arrays(
        [pa.array([rule.as_py()], rule.type), *lists], ["rule", "at", "entry", "free"]
    )


def _pack(silence: int, most: int):
    """Hits in the order of rule and time to chunks of at most ``most`` hits of one rule."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, parts, room = None, [], most
        for batch in batches:
            rules, times = batch.column(0), batch.column(1).to_numpy()
            if not len(rules):
                continue
            changed = pc.not_equal(rules.slice(1), rules.slice(0, len(rules) - 1))
            cuts = np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(rules)]):
                if parts and rules[start] != rule:
                    yield _chunk(rule, np.concatenate(parts), silence)
                    parts, room = [], most
                rule = rules[start]
                while start < end:
                    part = times[start : min(end, start + room)]
                    parts.append(part)
                    start, room = start + len(part), room - len(part)
                    if not room:
                        yield _chunk(rule, np.concatenate(parts), silence)
                        parts, room = [], most
        if parts:
            yield _chunk(rule, np.concatenate(parts), silence)

    return pack


def _walk(silence: int):
    """The fires of chunks, from the first one of each."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rule, times, entry in zip(*batch.columns):
                at = times.values.to_numpy()
                to = _steps(at, silence)[1].tolist()
                here, fired = int(np.searchsorted(at, entry.as_py())), []
                while here < len(at):
                    fired.append(here)
                    here = to[here]
                rules = pa.array([rule.as_py()] * len(fired), rule.type)
                yield pa.RecordBatch.from_arrays([rules, pa.array(at[fired])], ["rule", "at"])

    return walk


def _first_fires(chunks: DataFrame) -> DataFrame:
    """The first fire of every chunk that has one: (rule, first, entry).

    The hits that may be one are few. Each is linked to the one in a later chunk that it leads to,
    by their ranks ``pos`` and ``to`` in their rule, and the links are followed from the first hit
    of every rule, doubling the step each round.
    """
    ends = F.array(
        F.struct(F.lit("own").alias("role"), F.col("n.entry").alias("at")),
        F.struct(F.lit("next").alias("role"), F.col("n.free").alias("at")),
    )
    probes = cut_lineage(
        chunks.select("rule", "first", F.explode(F.arrays_zip("entry", "free")).alias("n"))
        .select("rule", "first", F.col("n.entry").alias("entry"), F.explode(ends).alias("p"))
        .select("rule", "first", "entry", "p.role", "p.at")
    )
    one = F.lit(1).cast("bigint").alias("weight")
    events = probes.where("role = 'own'").select("rule", "at", one)

    def role(name: str) -> Column:
        return F.max(F.when(F.col("role") == name, F.col("before")))

    chain = cut_lineage(
        counts_before(events, probes, ["rule"])
        .groupBy("rule", "first", "entry")
        .agg(role("own").alias("pos"), role("next").alias("to"))
    )
    reached = chain.where("pos = 0").select("rule", "pos")
    jump = chain.where("to > pos").select("rule", "pos", "to")
    while True:
        stepped = cut_lineage(
            reached.join(jump, ["rule", "pos"]).select("rule", F.col("to").alias("pos"))
        )
        if stepped.isEmpty():
            break
        reached = reached.unionByName(stepped)
        onward = jump.select("rule", F.col("pos").alias("to"), F.col("to").alias("_far"))
        jump = cut_lineage(
            jump.join(onward, ["rule", "to"]).select("rule", "pos", F.col("_far").alias("to"))
        )
    return chain.join(reached, ["rule", "pos"], "left_semi").select("rule", "first", "entry")


def fires(times: DataFrame, silence: int, chunk_hits: int = CHUNK_HITS) -> DataFrame:
    """Distinct (rule, at) that fire when a rule is silent for so long after each fire.

    Hits are dealt out by ranges of rule and time, in chunks of one rule. Which hit is the first
    fire of a chunk is found among those that can be; the others of the chunk follow from it.
    ``times`` are read twice, so let them be a stored table.
    """
    longs = [StructField(c, ArrayType(LongType())) for c in ("at", "entry", "free")]
    dealt = times.repartitionByRange("rule", "at").sortWithinPartitions("rule", "at")
    chunks = cut_lineage(
        dealt.mapInArrow(_pack(silence, chunk_hits), StructType([times.schema["rule"], *longs]))
        .withColumn("first", F.element_at("at", 1))
    )
    begun = chunks.select("rule", "first", "at").join(_first_fires(chunks), ["rule", "first"])
    return begun.select("rule", "at", "entry").mapInArrow(_walk(silence), times.schema)
