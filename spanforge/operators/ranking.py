"""Exact ranks and ordered counts that never put one key into one task.

A plain window per key sends a hot key (a third of all rows, say) to a single task. Here an
ordered bigint is split into three digits of 21 bits; counts per digit prefix are aggregated
map-side and only then ordered, so the windows over prefixes hold at most 2^21 rows whatever
the data looks like.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.session import cut_lineage

DIGIT_BITS = 21
_MASK = (1 << DIGIT_BITS) - 1

_LOW, _MID, _TOP = "_digit_low", "_digit_mid", "_digit_top"


def with_digits(df: DataFrame, value: Column) -> DataFrame:
    """Append three order-preserving digits of a bigint, most significant first."""
    return (
        df.withColumn(_TOP, F.shiftright(value, 2 * DIGIT_BITS))
        .withColumn(_MID, F.shiftright(value, DIGIT_BITS).bitwiseAND(F.lit(_MASK)))
        .withColumn(_LOW, value.bitwiseAND(F.lit(_MASK)))
    )


def _offsets(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Per digit prefix, the weight of all smaller prefixes of the same keys."""
    middle = counted.groupBy(*keys, _TOP, _MID).agg(F.sum("_w").alias("_w"))
    top = middle.groupBy(*keys, _TOP).agg(F.sum("_w").alias("_w"))

    def base(sizes: DataFrame, within: list[str], digit: str, name: str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(digit)
        running = F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return sizes.withColumn(name, F.coalesce(running, F.lit(0))).drop("_w")

    top_base = base(top, keys, _TOP, "_top_base")
    middle_base = base(middle, keys + [_TOP], _MID, "_middle_base")
    return middle_base.join(top_base, keys + [_TOP]).select(
        *keys, _TOP, _MID, (F.col("_top_base") + F.col("_middle_base")).alias("_base")
    )


def counts_before(
    events: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    at: str = "at",
    weight: str = "weight",
    out: str = "before",
) -> DataFrame:
    """For every probe row, the total weight of events of its keys with a smaller ``at``.

    Both frames have the key columns and a bigint ``at``; events have a ``weight``. Probes keep
    all their columns. Equal events are collapsed first, so copies cost nothing.
    """
    keys = list(keys)
    payload = [c for c in probes.columns if c not in keys and c != at]
    counted = events.groupBy(*keys, at).agg(F.sum(weight).alias("_w"))
    merged = with_digits(
        counted.select(*keys, at, "_w", F.lit(None).alias("_probe")).unionByName(
            probes.select(
                *keys,
                at,
                F.lit(0).cast("bigint").alias("_w"),
                F.struct(F.lit(True).alias("_is_probe"), *payload).alias("_probe"),
            )
        ),
        F.col(at),
    )
    offsets = _offsets(merged, keys)
    inside = (
        Window.partitionBy(*keys, _TOP, _MID)
        .orderBy(at)
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        merged.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .where(F.col("_probe").isNotNull())
        .join(offsets, keys + [_TOP, _MID])
        .select(
            *keys,
            at,
            *[F.col(f"_probe.{c}").alias(c) for c in payload],
            (F.col("_base") + F.col("_inside")).alias(out),
        )
    )


def pick_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Callable[[Column, Column, Column], Column],
    ties: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Rows holding wanted ranks when each key's rows are ordered by a bigint ``value``.

    ``wanted(first, end, total)`` says whether the 0-based ranks ``first <= r < end`` of a key
    with ``total`` rows contain a wanted one. The value is narrowed digit by digit: each pass
    counts map-side and keeps only the prefixes holding a wanted rank, so what is shuffled are
    counts. ``ties`` orders the rows of one value; they are looked at last, and only for the
    kept values, by ranges: a value that a million rows share is ordered in many tasks. With
    ties, jobs run while the result is built. With ``weight`` a row stands for that many. ``rows``
    are read once in every pass, so let them be a stored table. Returns keys, value, ``ties``, ``rank_first``,
    ``rank_end`` and ``total``.
    """
    keys, ties = list(keys), list(ties)
    each = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    rows = with_digits(rows.select(*keys, value, *ties, each.alias("_each")), F.col(value))
    passes = [([], [_TOP]), ([_TOP], [_MID]), ([_TOP, _MID], [value])]
    if ties:
        passes.append(([value], ties))
    kept: DataFrame | None = None
    for parents, order in passes:
        carried = [] if kept is None else ["_start", "total"]
        part = rows if kept is None else rows.join(kept, keys + parents)
        sizes = part.groupBy(*keys, *parents, *order, *carried).agg(F.sum("_each").alias("_n"))
        group = Window.partitionBy(*keys, *parents)
        if order == ties:
            sizes = sums_before(sizes, [*keys, *parents], ties, "_n", "_earlier")
        else:
            before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            sizes = sizes.withColumn("_earlier", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if kept is None:
            sizes = sizes.withColumn("total", F.sum("_n").over(group)).withColumn(
                "_start", F.lit(0).cast("bigint")
            )
        ranged = sizes.withColumn("rank_first", F.col("_start") + F.col("_earlier")).withColumn(
            "rank_end", F.col("rank_first") + F.col("_n")
        )
        hits = ranged.where(wanted(F.col("rank_first"), F.col("rank_end"), F.col("total")))
        prefix = [value] if value in order else parents + order
        kept = hits.select(*keys, *prefix, F.col("rank_first").alias("_start"), "total")
    return hits.select(*keys, value, *ties, "rank_first", "rank_end", "total")


def ranks(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    ties: Sequence[str],
    out: str = "rank",
) -> DataFrame:
    """0-based rank of every row inside its keys, by a bigint ``at`` and then ``ties``.

    Rows are ordered together only within one range of keys, ``at`` and ``ties``, so that neither
    a hot key nor a value that many rows share fills one task.
    """
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return sums_before(one, keys, [at, *ties], "_one", out).drop("_one")


def sums_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, out: str
) -> DataFrame:
    """For every row, the total ``weight`` of the rows of its keys that come before it in ``order``.

    Rows are dealt out by ranges of keys and order together, so one key may fill many tasks. Each
    range sums up its own rows; a key that runs over several ranges adds the totals of those before,
    of which there are at most two for each range. The ranges are checkpointed, because sampling
    again could draw them elsewhere.
    """
    keys, order = list(keys), list(order)
    ranged = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    own = Window.partitionBy("_range", *keys).orderBy(*order)
    before = F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("_range", *keys).agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_range", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base")
    ).where(F.col("_base") != 0)
    return (
        ranged.withColumn("_inside", before)
        .join(F.broadcast(bases), ["_range", *keys], "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_base", F.lit(0)))
        .drop("_range", "_inside", "_base")
    )
