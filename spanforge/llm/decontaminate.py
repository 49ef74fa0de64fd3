"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a bag of 5-word shingles (A-Z lower-cased; an item of fewer words is
one shingle) and a 128-bit SimHash of it. Windows of a document with as many words as an item
get the same fingerprint and meet the items of that length only. A multi-index cuts fingerprints
into two blocks of 64 bits, of which one may differ by 20 bits and the other by 19: 39 bits and
two blocks, so that a pair within 40 bits passes in a block at least (pigeonhole), while of
unrelated pairs one in 400 does. Those are compared on all bits. At the similarity sought the
distance is 22 bits on average, with a deviation of 4.3. Found items are verified by the exact
weighted similarity of the two bags: common over united occurrences, 0.75 or more.

Only windows that hold a shingle of an item of their length can reach any similarity with one, so
that only those around such a shingle are fingerprinted; nothing is lost by that. Of windows with
equal bags (by a 64-bit sum over the bag) in one document the first is looked at, so that
repetitive texts cost no more than their distinct windows. All windows of all documents are
covered, whole texts included, in one map without a shuffle; a task holds ``CHUNK`` windows at a
time.

The benchmark is a stated query set: the driver builds its index from at most ``BLOCK_BYTES`` of
text, which bounds what is broadcast; the documents are gone through once for each such block.
Items without words match nothing; equal items match alike. A document shorter than an item is
compared whole. Null and empty texts match nothing; repeated rows give repeated results. Other
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import WordHashes, as_bytes, in_worker, mix, shingles, small_batches, table

SHINGLE, SIMILARITY = 5, 0.75
BITS, RADIUS = 128, 40
#: Bits by which each block of 64 may differ; with one more in each, they exceed the radius.
ERRORS = (20, 19)
#: Bytes of benchmark text in an index.
BLOCK_BYTES = 64 << 20
#: Windows that are fingerprinted at a time, and window-item pairs that are compared at a time.
CHUNK, PAIRS = 4096, 1 << 22
BAGS = 4096


def votes(values: np.ndarray) -> np.ndarray:
    """For every shingle and bit, +1 or -1."""
    words = np.stack([values, mix(values + np.uint64(0x5851F42D4C957F2D))], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(values), 16), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(values: np.ndarray, width: int) -> np.ndarray:
    """SimHash, (n, 16) bytes, of every ``width`` shingles in a row."""
    n = len(values) - width + 1
    sums = np.zeros((n, BITS), np.int32)
    for at in range(0, width, CHUNK):
        sums[0] += votes(values[at : min(at + CHUNK, width)]).sum(0)
    sums[1:] = votes(values[width:]) - votes(values[: n - 1])
    return np.packbits(np.cumsum(sums, axis=0) > 0, axis=1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    return (a & b).total() / (a | b).total()


class Index:
    """Items by length and fingerprint block, and their shingles; numpy arrays, so that it can be sent."""

    def __init__(self, items: list[tuple[int | None, bytes]], known: WordHashes) -> None:
        self.ids, lengths, bags, prints = [], [], [], []
        for item_id, text in items:
            hashes = known.of(text.lower().split())
            if not len(hashes):
                continue
            bags.append(shingles(hashes, SHINGLE))
            self.ids.append(item_id)
            lengths.append(len(hashes))
            prints.append(fingerprints(bags[-1], len(bags[-1]))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, BITS // 8)
        self.lengths = np.array(lengths, np.int64)
        self.sizes = sorted({min(SHINGLE, n) for n in lengths})
        self.by_length = {int(n): np.flatnonzero(self.lengths == n) for n in np.unique(self.lengths)}
        self.values = np.concatenate([*bags, np.empty(0, np.uint64)])
        self.ends = np.cumsum([len(b) for b in bags], dtype=np.int64)
        #: Every shingle with the lengths of the items that hold it, in order.
        of = np.repeat(self.lengths, [len(b) for b in bags])
        order = np.lexsort((of, self.values))
        keys, of = self.values[order], of[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        self.keys, self.key_lengths = keys[first], of[first]
        self.mask = np.uint64((1 << max(20, (16 * len(self.keys)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(self.keys & self.mask).astype(np.int64)] = True

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        index.__dict__.update(state, bags={})
        return index

    def bag(self, item: int) -> Counter:
        bags = self.__dict__.setdefault("bags", {})
        if item not in bags:
            if len(bags) >= BAGS:
                bags.clear()
            begin = int(self.ends[item - 1]) if item else 0
            bags[item] = Counter(self.values[begin : self.ends[item]].tolist())
        return bags[item]

    def passing(self, prints: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, items of this length and their distances, of pairs that pass in some block."""
        items = self.by_length.get(length, np.empty(0, np.int64))
        windows = np.ascontiguousarray(prints).view(np.uint64)
        step = max(1, PAIRS // max(1, len(windows)))
        for at in range(0, len(items), step):
            some = items[at : at + step]
            blocks = np.ascontiguousarray(self.prints[some]).view(np.uint64)
            apart = [np.bitwise_count(windows[:, None, b] ^ blocks[None, :, b]) for b in range(len(ERRORS))]
            w, i = np.nonzero((apart[0] <= ERRORS[0]) | (apart[1] <= ERRORS[1]))
            yield w, some[i], apart[0][w, i].astype(np.int64) + apart[1][w, i]

    def candidates(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """Window and item of this length whose fingerprints are within the radius."""
        for w, i, distance in self.passing(prints, length):
            near = distance <= RADIUS
            yield from zip(w[near].tolist(), i[near].tolist(), strict=True)

    def matches(self, hashes: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best similarity and its first window, for every item that a document holds."""
        best: dict[int, tuple[float, int]] = {}
        n = len(hashes)
        for size in self.sizes:
            if n < size:
                break
            values = shingles(hashes, size)
            sums = None
            for length, begins, ends in self._windows(values, n, size):
                if sums is None:
                    sums = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(mix(values + np.uint64(1)), out=sums[1:])
                width = min(length, n) - size + 1
                for start, prints in _distinct_windows(values, sums, width, begins, ends):
                    for w, i in self.candidates(prints, length):
                        at = int(start[w])
                        similarity = weighted_similarity(Counter(values[at : at + width].tolist()), self.bag(i))
                        if similarity >= SIMILARITY and (-similarity, at) < (-best.get(i, (0, 0))[0], best.get(i, (0, 0))[1]):
                            best[i] = (similarity, at)
        return best

    def _windows(self, values: np.ndarray, n: int, size: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """For each item length, ranges of window starts that hold a shingle of such an item."""
        at = np.flatnonzero(self.maybe[(values & self.mask).astype(np.int64)])
        distinct, which = np.unique(values[at], return_inverse=True)
        low, high = (np.searchsorted(self.keys, distinct, side) for side in ("left", "right"))
        counts = high - low
        holder = np.repeat(np.arange(len(distinct)), counts)
        lengths = self.key_lengths[np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)]
        order = np.argsort(lengths, kind="stable")
        present, first = np.unique(lengths[order], return_index=True)
        for length, holders in zip(present.tolist(), np.split(holder[order], first[1:]), strict=False):
            has = np.zeros(len(distinct), bool)
            has[holders] = True
            places = at[has[which]]
            width, last = min(length, n) - size + 1, max(0, n - length)
            begins, ends = np.maximum(0, places - width + 1), np.minimum(places, last) + 1
            cut = np.flatnonzero(begins[1:] > ends[:-1]) + 1
            yield length, begins[[0, *cut]].tolist(), ends[[*(cut - 1), -1]].tolist()


def _distinct_windows(
    values: np.ndarray, sums: np.ndarray, width: int, begins: list[int], ends: list[int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and fingerprints of the windows of these ranges, the first of each bag."""
    seen: set[int] = set()
    for range_begin, range_end in zip(begins, ends, strict=True):
        for begin in range(range_begin, range_end, CHUNK):
            end = min(begin + CHUNK, range_end)
            bags, first = np.unique(sums[begin + width : end + width] - sums[begin:end], return_index=True)
            new = [k for k, b in enumerate(bags.tolist()) if b not in seen]
            if new:
                seen.update(bags[new].tolist())
                chosen = np.sort(first[new])
                yield begin + chosen, fingerprints(values[begin : end + width - 1], width)[chosen]


def _indexes(items: DataFrame) -> Iterator[Index]:
    """An index of every ``BLOCK_BYTES`` of item texts."""
    rows = items.selectExpr("cast(item_id AS bigint) AS item_id", "cast(text AS string) AS text").toLocalIterator()
    block, size = [], 0
    for r in rows:
        text = (r["text"] or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield Index(block, WordHashes())
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield Index(block, WordHashes())


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, similarity`` for every benchmark item in a document (its best window)."""
    shape = "doc_id long, item_id long, start long, similarity double"
    plain = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    out = docs.sparkSession.createDataFrame([], shape)
    for index in _indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def scan(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            known = in_worker("hashes", WordHashes)
            index = Index.of(sent.value)
            for batch in small_batches(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                    found = index.matches(known.of(text.lower().split()))
                    rows += [(doc_id, index.ids[i], at, s) for i, (s, at) in sorted(found.items())]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "start", "similarity"],
                )

        out = out.unionByName(plain.mapInArrow(scan, shape))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns; no shuffle."""
    names = docs.columns
    for index in _indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def scan(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            known = in_worker("hashes", WordHashes)
            index = Index.of(sent.value)
            for batch in small_batches(batches):
                texts = as_bytes(batch.column(names.index("text")))
                keep = [not index.matches(known.of(t.lower().split())) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
