"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

Every distinct set of 5-word shingles is a node with a signature of 40 symbols, the low 16 bits
of 40 minima. The distance of two signatures is the number of symbols that differ; the symbols
are cut into 10 chunks of 4. Of two signatures at distance 19 or less, some chunk differs in one
symbol at most (pigeonhole). A node therefore files under every chunk with every one of its
symbols left out, and all pairs within that distance share a bucket, as do most pairs beyond. A
pair at similarity 0.75 shares no bucket with probability 1.5e-6, at 0.8 with 4e-8.

Buckets are searched without listing their pairs:

1. Every member is compared with the bucket's smallest node: by size, then on full shingle sets,
   however far their signatures are. Components of the links found give labels.
2. Only buckets with members of different labels are left to search, now exhaustively: blocks of
   at most ``BLOCK`` members or so meet every other block of the bucket in a task, which
   intersects their full sets and reports links that join labels. A bucket of any size is cut
   into blocks; none is dropped.

No link between different texts that share a bucket is lost to a component. Links are confirmed
on full sets of 64-bit shingle hashes, of the whole text.

Copies are one node, so they are never expanded into pairs. Documents without words are empty,
linked with nothing and keep their own id. ``component_id`` is the smallest non-null id;
repeated rows share it, and a null id is kept only if its whole component has none. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import (
    WordHashes, as_bytes, drop_stored, in_worker, mix, row_key, shingles, small_batches, stored, table,
)
from spanforge.llm.components import components

SHINGLE, PART, WHOLE = 5, 75, 100
CHUNKS, CHUNK, BITS = 10, 4, 16
SYMBOLS = CHUNKS * CHUNK
BLOCK = 1024


def shingle_set(known: WordHashes, text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(shingles(known.of(text.lower().split()), size))


def signature(values: np.ndarray) -> np.ndarray:
    """The low bits of the minima of ``SYMBOLS`` hash functions."""
    factors = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(101, SYMBOLS + 101, dtype=np.uint64))
    least = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for at in range(0, len(values), 4096):
        hashed = values[at : at + 4096, None] * factors + shifts
        least = np.minimum(least, (hashed ^ (hashed >> np.uint64(31))).min(0))
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, kid, kh, n, node, symbols`` of every row; the last two are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker("hashes", WordHashes)
        for batch in small_batches(batches):
            sizes, nodes, symbols = [], [], []
            for text in as_bytes(batch.column("text")):
                values = shingle_set(known, text)
                sizes.append(len(values))
                nodes.append(xxhash.xxh64_intdigest(values.tobytes()) - 2**63 if len(values) else None)
                symbols.append(signature(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("kid"), batch.column("kh"), pa.array(sizes, pa.int64()),
                 pa.array(nodes, pa.int64()), pa.array(symbols, pa.list_(pa.int32()))],
                names=["doc_id", "kid", "kh", "n", "node", "symbols"],
            )

    shape = "doc_id long, kid long, kh long, n long, node long, symbols array<int>"
    return docs.select(F.col("doc_id").cast("long"), *row_key(), "text").mapInArrow(sign, shape)


def bucket_keys(symbols: Column) -> Column:
    """Chunk number, symbol left out, and the chunk's other symbols, in one long."""
    keys = []
    for chunk in range(CHUNKS):
        for out in range(CHUNK):
            key = F.lit(chunk * CHUNK + out).cast("long")
            for i in range(CHUNK):
                if i != out:
                    key = key * (1 << BITS) + F.get(symbols, F.lit(chunk * CHUNK + i))
            keys.append(key)
    return F.array(*keys)


def _similar(both: Column, a: Column, b: Column) -> Column:
    return WHOLE * both >= PART * (a + b - both)


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, values`` of the rows of ``docs`` named by ``wanted`` (kid, kh, node).

    Of equal rows one is parsed.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker("hashes", WordHashes)
        for batch in small_batches(batches):
            sets = [shingle_set(known, t).view(np.int64) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["node", "n", "values"],
            )

    joined = docs.select(*row_key(), "text").join(wanted, ["kid", "kh"]).dropDuplicates(["kid", "kh"])
    return joined.select("node", "text").mapInArrow(parse, "node long, n long, values array<long>")


def _first_links(buckets: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the members of each bucket and its smallest node."""
    pairs = buckets.filter("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    near = (
        pairs.join(side("u"), "u").join(side("v"), "v")
        .filter(_similar(F.least("n_u", "n_v"), F.col("n_u"), F.col("n_v")))
        .select("u", "v")
    )
    with_sets = near.join(sets.select(F.col("node").alias("u"), F.col("values").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("values").alias("b")), "v"
    )
    both = F.size(F.array_intersect("a", "b"))
    return with_sets.filter(_similar(both, F.size("a"), F.size("b"))).select("u", "v")


def joining_links(values: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of labels joined by a similar pair of sets, enough to span all that are."""
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((len(values), len(values)), np.int64)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        width = max(1, (1 << 23) // len(values))
        for begin in range(0, int(column[-1]) + 1, width):  # a slice of columns at a time bounds the memory
            own = slice(*np.searchsorted(column, [begin, begin + width]))
            dense = np.zeros((len(values), width), np.float32)
            dense[owner[own], column[own] - begin] = 1
            both += (dense @ dense.T).astype(np.int64)  # below 2^24, where these are exact
    sizes = sizes.astype(np.int64)
    hits = ((WHOLE + PART) * both >= PART * (sizes[:, None] + sizes[None, :])) & (labels[:, None] != labels[None, :])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(hits)), strict=True):
        a, b = top(int(labels[i])), top(int(labels[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(labels[i]), int(labels[j])))
    return out


def _remaining_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between labels inside buckets that hold several, from blocks against blocks."""
    members = stored(
        buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")),
        "members",
    )
    # Of two members, one was the smallest node of the bucket: that pair has been compared.
    open_ = members.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    ).filter("low < high AND size > 2")
    # Near copies meet in many buckets; each list of members, known by 128 bits, is searched once.
    open_ = open_.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(block, x).alias("i"), F.greatest(block, x).alias("j")),
    )
    placed = members.join(open_, "key").select("key", "node", "label", F.explode(meetings).alias("m"))

    def search(group: pa.Table) -> pa.Table:
        labels = group.column("label").to_numpy()
        links: list[tuple[int, int]] = []
        if (labels != labels[0]).any():
            column = group.column("values").combine_chunks()
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            values = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            links = joining_links(values, group.column("n").to_numpy(), labels)
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    rows = placed.join(sets, "node").select("key", "m.i", "m.j", "label", "n", "values")
    return rows.groupBy("key", "i", "j").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, kid, kh, n_shingles, component_id, kept`` for every row of ``docs``.

    ``kid, kh`` name the row for joins (``common.row_key``).
    """
    return _placed(docs).drop("component")


def _placed(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the node that names the component, null without words."""
    signed = stored(signatures(docs), "signatures")
    unit = F.xxhash64("kid", "kh")
    firsts = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(unit).alias("unit"))
    nodes = stored(
        signed.withColumn("unit", unit).join(firsts, ["node", "unit"])
        .select("node", "n", "symbols", "kid", "kh").dropDuplicates(["node"]),  # equal rows share the unit
        "nodes",
    )
    keyed = nodes.select("node", F.explode(bucket_keys(F.col("symbols"))).alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top")
    buckets = stored(keyed.join(several.drop("top"), "key"), "buckets")
    wanted = nodes.select("kid", "kh", "node").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = stored(_shingle_sets(docs, wanted), "sets")

    links = stored(_first_links(buckets, nodes, sets), "first-links")
    labels = stored(components(links), "labels")
    more = stored(_remaining_links(buckets, labels, sets), "more-links")
    drop_stored(buckets, nodes, sets)
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    final = labels.join(joined, "label", "full").select(
        F.coalesce("node", "label").alias("node"), F.coalesce("joined", "label").alias("component")
    )
    placed = stored(
        signed.join(final, "node", "left").select(
            "doc_id", "kid", "kh", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component")
        ), "placed",
    )
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")
    ).filter("rows > 1").drop("rows")
    of_all = F.when(F.col("grouped"), F.col("least")).otherwise(F.col("doc_id"))
    return placed.join(least.withColumn("grouped", F.lit(True)), "component", "left").select(
        "doc_id", "kid", "kh", "n_shingles", of_all.alias("component_id"),
        F.col("doc_id").eqNullSafe(of_all).alias("kept"), "component",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with their own columns.

    Of rows without words those equal in id and text are one. Of the kept rows of a component the
    one of smallest ``kid, kh`` stays, of rows equal in these the one of smallest hash.
    """
    kid, kh = row_key()
    empty = F.col("component").isNull()
    kept = _placed(docs).filter("kept").groupBy(
        "component", F.when(empty, F.col("kid")).alias("empty_kid"), F.when(empty, F.col("kh")).alias("empty_kh")
    ).agg(F.min(F.struct("kid", "kh")).alias("least")).select("least.*")
    names = [f"`{c}`" for c in docs.columns]
    # Maps have no hash; of rows that differ in maps alone any one stays.
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.struct(*names).alias("row"), F.xxhash64(*hashed).alias("hash"), kid, kh)
    staying = keyed.join(kept, ["kid", "kh"], "left_semi")
    return staying.groupBy("kid", "kh").agg(F.min_by("row", "hash").alias("row")).select("row.*")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("kid", "kh")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v
      WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.v) AS component_id,
       d.doc_id = min(r.v) AS kept
FROM d JOIN r ON r.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
