"""Helpers of the training-data operators: words, hashes, scratch tables on shared storage.

A *word* is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``: what ``bytes.split()``
yields on UTF-8. Texts travel as Arrow binary, so nothing is decoded that need not be.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import checkpoint_root

#: A run of white space as the operators define it, for Java regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with a table that outlives any executor. Shuffle files of the job that
    wrote it are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.stored_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the third kept for testing: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key() -> list[Column]:
    """Two longs that name a row by id and content; equal rows share them."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kid"),
        F.xxhash64(F.col("text")).alias("kh"),
    ]


def in_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task, such as a tokenizer."""
    kept = sys.modules.setdefault("spanforge_llm_worker", types.ModuleType("spanforge_llm_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; fewer words make one run of them all."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        total = total * factor + hashes[j : n - size + 1 + j]
    return mix(total + np.uint64(size))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes, one row at least."""
    for batch in batches:
        begin = 0
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        while begin < batch.num_rows:
            yield batch.slice(begin, step)
            begin += step
