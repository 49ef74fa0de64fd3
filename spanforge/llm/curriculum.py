"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sizes of all sources are shared out by weight; a source's target stops at three
times its size, and what is left over is shared again by weight, until none is above. That is
filling vessels to a common level: ``target = min(3 size, weight * level)``, where the level is
the greatest, over all ways to split the sources by ``size / weight``, of what is left for the
upper part over its weights.

Demand: a source of slope ``r`` is asked for at the rate ``1 + r (2 t - 1)`` times its target at
training time ``t`` from 0 to 1. The integral ``(1 - r) t + r t^2`` of that rate is inverted to
place what has been taken before a document, so that early and late sources interleave as their
schedules say.

Order: within a source, documents follow the MD5 of their id, pass after pass, until the target
is met; the last pass may end inside a document. Positions before a document are sums over
4096 ranges of the digest plus a running sum inside one range, so that no task holds a source.

Null and empty texts have size 0 and take nothing, null is a source of its own (the last one),
and repeated rows count each. Rows with equal id and size are interchangeable. All sizes 0
give targets 0; an empty table gives no rows. Input columns travel in one struct, so that
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import table

MOST = 3
#: Slopes of the schedules, dealt out to the sources in their order.
SLOPES = (-0.5, 0.0, 0.5)
DIGITS = 3  # hexadecimal digits of the digest that name a range: 4096 ranges


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source_key, source_size, weight, slope, target`` of ``sizes`` (source_key, source, size).

    Its windows run over one row per source.
    """
    by_source = sizes.groupBy("source_key").agg(
        F.max("source").alias("source"), F.sum("size").alias("source_size")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    slopes = F.array(*(F.lit(float(s)) for s in SLOPES))
    ranked = by_source.withColumn("weight", (rank % 3 + 1).cast("long")).withColumn(
        "slope", F.get(slopes, (rank % len(SLOPES)).cast("int"))
    )
    by_fill = Window.orderBy(MOST * F.col("source_size") / F.col("weight"), "source_key")
    everything = Window.partitionBy()
    lower = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - MOST * F.coalesce(
        F.sum("source_size").over(lower), F.lit(0)
    )
    upper = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("split", left / upper)
    filled = F.max("split").over(everything)
    target = F.least((MOST * F.col("source_size")).cast("double"), F.col("weight") * filled)
    return level.select("source_key", "source_size", "weight", "slope", target.alias("target"))


def _time(share: Column, slope: Column) -> Column:
    """The training time at which a source of this slope has given this share of its target."""
    linear = 1 - slope
    root = F.sqrt(linear * linear + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - linear) / (2 * slope))


def curriculum(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row, size, source_size, target, passes`` for every document.

    ``row`` holds the columns named in ``carry`` (default: all); ``passes`` has ``position`` and
    ``words`` of each time that the mix takes the document, in order.
    """
    names = docs.columns if carry is None else carry
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), n_words(F.col("text")).alias("size"),
        "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source_key"),
        digest.alias("digest"), F.substring(digest, 1, DIGITS).alias("range"),
    )
    ranges = sized.groupBy("source_key", "range").agg(
        F.max("source").alias("source"), F.sum("size").alias("size")
    )
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select(
        "source_key", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base")
    ).join(source_targets(ranges), "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy("digest", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = sized.drop("source").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bases, ["source_key", "range"]).withColumn("before", F.col("base") + F.col("inside"))

    of_source, size, target = F.col("source_size"), F.col("size"), F.col("target")
    goal = F.floor(target + 0.5)

    def one_pass(k: Column) -> Column:
        done = k * of_source + F.col("before")
        words = F.greatest(F.lit(0), F.least(size, goal - done)).cast("long")
        return F.struct(_time(F.try_divide(done, goal), F.col("slope")).alias("position"), words.alias("words"))

    passes = F.filter(
        F.transform(F.array(*(F.lit(k).cast("long") for k in range(MOST))), one_pass),
        lambda p: p["words"] > 0,
    )
    return placed.select("row", "size", "source_size", "target", passes.alias("passes"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each taking, range-sorted by training position: ``row, size, position, words``."""
    takings = mixed.select("row", "size", F.explode("passes").alias("p"))
    return takings.select("row", "size", "p.position", "p.words").orderBy("position", "row.doc_id")


def whole_passes(mixed: DataFrame) -> DataFrame:
    """The rows taken, in training order, once for each pass.

    The pass that meets a source's target inside a document is rounded to a whole pass or none.
    Documents without words are not taken.
    """
    return training_order(mixed).filter(2 * F.col("words") >= F.col("size")).select("row.*")


def document_order(mixed: DataFrame) -> DataFrame:
    """One row for each document, range-sorted by its training positions; those not taken last.

    ``doc_id, size, source_size, target, taken``. Documents lie by their first taking, then by
    the later ones.
    """
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    at = [F.get("passes", F.lit(k))["position"].asc_nulls_last() for k in range(MOST)]
    ordered = mixed.orderBy(*at, F.col("row.doc_id"), "size")
    return ordered.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in training order; their columns are those of ``OP6_SQL``, which does not order."""
    return document_order(curriculum(table(spark, sf_dir, "documents"), carry=["doc_id"]))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size,
             CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
l AS (SELECT *, CAST((sum(source_size) OVER ()
                 - 3 * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
               / CAST(sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS split
      FROM w WINDOW f AS (ORDER BY 3 * source_size / weight, coalesce('s' || source, ''))),
t AS (SELECT source, source_size,
             least(CAST(3 * source_size AS DOUBLE), weight * max(split) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - before))
          + greatest(0, least(size, goal - before - source_size))
          + greatest(0, least(size, goal - before - 2 * source_size)) AS BIGINT) AS taken
FROM p
"""
