"""Exact dedup by skew-safe combining, in DataFrame functions only.

Rows with equal content are combined three times, always comparing the full content beside its
digest: each task combines what it reads (the partial aggregation before the first shuffle),
then the rows of one salt of a digest, then the winners of all salts. A hot text thus reaches
any task as one row for each task that read it (first) or for each salt (second).

Rows then take their class by digest. That is safe because the last combining has seen every
distinct content: should two contents share a digest, ``raise_error`` stops the job rather than
merge them.

Empty and null texts are equal to each other. Of rows that also repeat the id, all have the
same ``keep_id``, and every one of them counts as kept. A null id loses to any other; a class of
null ids only keeps null. Other columns, clashing names included, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import SPACES, table

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    content = docs.select("doc_id", normalised(F.col("text")).alias("content")).select(
        "doc_id", "content", F.sha2("content", 256).alias("text_sha256")
    )
    salted = content.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    winners = salted.groupBy("text_sha256", "salt", "content").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    classes = winners.groupBy("text_sha256", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    by_digest = classes.groupBy("text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("contents"),
    )
    several = by_digest.filter((F.col("group_size") > 1) | (F.col("contents") > 1)).select(
        "text_sha256", "keep_id",
        F.when(F.col("contents") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.concat(F.lit("two contents share the digest "), "text_sha256"))
        ).cast("long").alias("group_size"),
    )
    # A text that occurs once needs no partner: only the others travel to the join.
    joined = content.select("doc_id", "text_sha256").join(several, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS c FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS keep_id,
       count(*) OVER (PARTITION BY c) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY c) AS kept,
       sha256(c) AS text_sha256
FROM t
"""
