"""Substring dedup by seed and extend over winnowed anchors.

A window is ``WINDOW`` consecutive words. Its anchor is the smallest of the hashes of the 8-word
runs inside it, the first one on ties: equal windows have the same anchor at the same place.
Neighbouring windows mostly share an anchor; such a stretch of windows is one *seed*, about one
for every 14 words.

Seeds are joined on their anchor and extended both ways, without a pair of documents:

* an anchor that occurs once repeats nothing;
* seeds that reach equally far to both sides over equal words repeat wholly (they share a *run*);
* the other seeds of a repeated anchor meet only in part. They are extended window by window,
  against one representative of every run of that anchor.

Every step counts keys with combining before the shuffle, so that a passage in a third of all
documents reaches a task as one row from each task before. Overlapping repeated windows merge
into maximal repeats, whose words are removed. Runs and windows are compared by 64-bit hashes of
their words together with the anchor's.

Windows are judged on the input. A null text has no words; a text of fewer words than a window
keeps them all. Rows that are equal in id and text repeat each other, as any two documents do,
and each gives a row; null ids are allowed. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import (
    WordHashes, as_bytes, drop_stored, in_worker, mix, row_key, shingles, small_batches, stored, table,
)

WINDOW, ANCHOR = 35, 8
FACTOR = 0xD6E8FEB86659FD93
#: What a marked stretch is for: it repeats; extend it; it repeats and stands for its run.
COVER, EXTEND, BOTH = 0, 1, 2


class Spans:
    """Hashes of any stretch of words of one text, from running sums of a polynomial."""

    factors = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.factors) < n:
            inverse = np.uint64(pow(FACTOR, -1, 2**64))
            with np.errstate(over="ignore"):
                cls.factors = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, FACTOR, np.uint64)], dtype=np.uint64)
                cls.inverses = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, inverse, np.uint64)], dtype=np.uint64)

    def __init__(self, hashes: np.ndarray) -> None:
        self.grow(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.factors[: len(hashes)], out=self.sums[1:])

    def hash(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[begins]) * self.inverses[begins]


def seeds_of(hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, first and last window of every seed of a text."""
    anchors = shingles(hashes, ANCHOR)
    inside = np.lib.stride_tricks.sliding_window_view(anchors, window - ANCHOR + 1)
    places = inside.argmin(1) + np.arange(len(inside))
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    last = np.r_[first[1:] - 1, len(places) - 1]
    at = places[first]
    reach = (at - first).astype(np.uint64) * np.uint64(65536) + (last - first).astype(np.uint64)
    runs = mix(Spans(hashes).hash(first, last + window) ^ mix(reach + np.uint64(1)))
    return anchors[at], runs, first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _seed_table(docs: DataFrame, window: int) -> DataFrame:
    """``kid, kh, anchor, run, first, last, unit`` of every seed; ``unit`` names it."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker("hashes", WordHashes)
        for batch in small_batches(batches, 2_000_000):
            kid, kh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kid", "kh"))
            parts, owners = [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = text.split()
                if len(words) >= window:
                    parts.append(seeds_of(known.of(words), window))
                    owners.append(np.full(len(parts[-1][0]), i))
            if not parts:
                continue
            anchor, run, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = np.concatenate(owners)
            unit = mix(mix(kid[owner].view(np.uint64)) ^ kh[owner].view(np.uint64) + first.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kid[owner]), pa.array(kh[owner]), _signed(anchor), _signed(run),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), _signed(unit)],
                names=["kid", "kh", "anchor", "run", "first", "last", "unit"],
            )

    shape = "kid long, kh long, anchor long, run long, first int, last int, unit long"
    return docs.select(*row_key(), "text").mapInArrow(plant, shape)


def _extended(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """``kid, kh, key, start, asks`` for every window of the marked seeds that meet in part."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker("hashes", WordHashes)
        for batch in small_batches(batches, 2_000_000):
            kid, kh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kid", "kh"))
            out = []
            for i, (text, marked) in enumerate(
                zip(as_bytes(batch.column("text")), batch.column("marks").to_pylist(), strict=True)
            ):
                hashes = known.of(text.split())
                spans, anchors = Spans(hashes), shingles(hashes, ANCHOR)
                for m in marked:
                    if m["kind"] == COVER:
                        continue
                    starts = np.arange(m["first"], m["last"] + 1)
                    inside = anchors[m["first"] : m["first"] + window - ANCHOR + 1]
                    at = m["first"] + int(inside.argmin())
                    keys = mix(spans.hash(starts, starts + window) ^ mix(anchors[at] + (at - starts).astype(np.uint64)))
                    out.append((np.full(len(starts), i), keys, starts, np.full(len(starts), m["kind"] == EXTEND)))
            if not out:
                continue
            owner, keys, starts, asks = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kid[owner]), pa.array(kh[owner]), _signed(keys), pa.array(starts.astype(np.int32)), pa.array(asks)],
                names=["kid", "kh", "key", "start", "asks"],
            )

    wanted = marks.filter(F.exists("marks", lambda m: m["kind"] != COVER))
    joined = docs.select(*row_key(), "text").join(wanted, ["kid", "kh"])
    return joined.mapInArrow(extend, "kid long, kh long, key long, start int, asks boolean")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``kid, kh, found``: the stretches of repeated windows of each document that has any.

    ``found`` lists first and last window starts; they may overlap.
    """
    seeds = stored(_seed_table(docs, window), "seeds")
    runs = seeds.groupBy("anchor", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("unit").alias("representative")
    )
    anchors = runs.groupBy("anchor").agg(F.sum("n").alias("n_anchor"), F.count(F.lit(1)).alias("n_runs"))
    met = runs.join(anchors.filter("n_anchor > 1"), "anchor").withColumn("alone", F.col("n_runs") == 1)
    kind = (
        F.when(F.col("n") == 1, EXTEND)
        .when(~F.col("alone") & (F.col("unit") == F.col("representative")), BOTH)
        .otherwise(COVER)
    )
    marks = stored(
        seeds.join(met.select("anchor", "run", "n", "representative", "alone"), ["anchor", "run"])
        .groupBy("kid", "kh")
        .agg(F.collect_set(F.struct("first", "last", kind.alias("kind"))).alias("marks")),
        "marks",
    )
    drop_stored(seeds)
    windows = stored(_extended(docs, marks, window), "windows")
    shared = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    partly = windows.filter("asks").join(shared, "key").select(
        "kid", "kh", F.struct(F.col("start").alias("first"), F.col("start").alias("last")).alias("stretch")
    )
    wholly = marks.select("kid", "kh", F.explode("marks").alias("m")).filter(F.col("m.kind") != EXTEND).select(
        "kid", "kh", F.struct("m.first", "m.last").alias("stretch")
    )
    return wholly.unionByName(partly).groupBy("kid", "kh").agg(F.collect_set("stretch").alias("found"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, repeats, kept_text`` for every row of ``docs``.

    ``repeats`` holds the maximal repeats as ``begin`` and ``end`` (exclusive) words.
    """
    found = stored(repeats(docs, window), "repeats")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts, removed, spans, kept = [], [], [], []
            for text, stretches in zip(
                as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True
            ):
                words = text.split()
                own: list[list[int]] = []
                for begin, end in sorted((s["first"], s["last"] + window) for s in stretches or ()):
                    if own and begin <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([begin, end])
                rest, at = [], 0
                for begin, end in own:
                    rest += words[at:begin]
                    at = end
                rest += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(rest))
                spans.append([{"begin": b, "end": e} for b, e in own])
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "repeats", "kept_text"],
            )

    joined = docs.select(F.col("doc_id").cast("long"), *row_key(), "text").join(found, ["kid", "kh"], "left")
    shape = "doc_id long, n_words long, n_removed long, repeats array<struct<begin: long, end: long>>, kept_text string"
    return joined.select("doc_id", "text", "found").mapInArrow(remove, shape)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT s.r, s.i, md5_number(array_to_string(d.w[s.i:s.i + 34], ' ')) AS h FROM s JOIN d USING (r)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
cov AS (SELECT DISTINCT r, i + o AS p FROM rep, range(35) t(o)),
wd AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT wd.r, string_agg(wd.x, ' ' ORDER BY wd.p) AS kept, count(*) AS n
      FROM wd ANTI JOIN cov USING (r, p) GROUP BY wd.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
