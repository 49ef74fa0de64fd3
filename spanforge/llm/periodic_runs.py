"""Periodic runs: stretches of words that repeat with a period, found as maximal pairs.

Each text is handled whole. Its words become numbers that no other text shares, so that the texts
of a batch can be sorted as one: prefix doubling names all stretches of 1, 2, 4, ... words and
refines only places whose stretch occurs again. The names give the common prefix of neighbours in
the suffix order, and a stack walks the intervals of equal prefixes bottom up.

Two places i < j of one interval that come from different children, and whose left words differ, are
a maximal pair: the ``length`` common words cannot be extended on either side. With
``q = j - i <= length / (times - 1)`` the stretch from i over ``q + length`` words has period q
and no neighbour keeps it, so it is a run without any further extension. Pairs of one left word are
never listed. Places of an interval are kept in order, each belonging to the class of its
left word, and in reach of one another they are spaced by the least period of the common stretch
(Fine and Wilf, as ``times`` is 3 at least), so that all of them but the first share one class. A
place therefore meets at most one partner of another class before it, the first in reach, and behind
it either all places in reach are partners or none is. Multiples of the least period give the same stretch and are dropped. Work
is about n log^2 n for n words, whatever their repeats.

Null and empty texts, and texts without repeats, have no runs. Ties of length are left to the
reader of ``runs``, which are ordered by start, then period. Each row is looked at by itself: rows
of equal or null id and repeated rows give a row each, an empty table none. Columns other than
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import as_bytes, small_batches, table

LEAST_LENGTH, TIMES = 6, 4
#: Words sorted as one batch; a longer text is a batch of its own.
TOGETHER = 200_000

Words = list[bytes]


def _names(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix order of ``symbols``, and for k = 0, 1, ... a name of the 2^k words at each place.

    Equal names mean equal stretches. Names beyond the end are 0. Stops when no stretch occurs
    twice or exceeds ``longest``.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    begins = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    slot = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    name = np.zeros(n + 1, np.int64)
    name[order] = slot + 1
    levels, reach = [name], 1
    # Slots of the order whose stretch occurs more than once.
    alone = begins & np.concatenate((begins[1:], [True]))
    open_slots = np.flatnonzero(~alone)
    while len(open_slots) and reach <= longest:
        places = order[open_slots]
        first = name[places]
        key = first * (n + 2) + name[np.minimum(places + reach, n)]
        turn = np.argsort(key, kind="stable")
        places, key, first = places[turn], key[turn], first[turn]
        order[open_slots] = places
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        # The first slot of a group names it, as before.
        slot = np.maximum.accumulate(np.where(begins, open_slots, 0))
        name = name.copy()
        name[places] = slot + 1
        levels.append(name)
        alone = begins & np.concatenate((begins[1:], [True]))
        open_slots = open_slots[~alone]
        reach *= 2
    return order, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` begin with in common."""
    end = len(levels[0]) - 1
    a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        same = name[np.minimum(a, end)] == name[np.minimum(b, end)]
        step = same.astype(np.int64) << k
        a, b, length = a + step, b + step, length + step
    return length


class _Interval:
    """An interval of equal prefixes: its length, and its places in order."""

    __slots__ = ("length", "places")

    def __init__(self, length: int, places: list[int]):
        self.length, self.places = length, places


def _merge(into: _Interval, child: list[int], left: list[int], times: int, pairs: list) -> None:
    """Add the places of a child to its parent, listing the maximal pairs between them."""
    length, mine, theirs = into.length, into.places, child
    reach = length // (times - 1)
    if len(mine) < len(theirs):
        mine, theirs = theirs, mine
    if mine and reach:
        for place in theirs:
            own = left[place]
            at = bisect_left(mine, place - reach)
            if at < len(mine) and mine[at] < place and left[mine[at]] != own:
                pairs.append((mine[at], place, length))
            at = bisect_left(mine, place)
            while at < len(mine) and mine[at] <= place + reach and left[mine[at]] != own:
                pairs.append((place, mine[at], length))
                at += 1
    if len(theirs) * 8 > len(mine):
        mine.extend(theirs)
        mine.sort()
    else:
        for place in theirs:
            insort(mine, place)
    into.places = mine


def _walk(places: list[int], common: list[int], left: list[int], times: int, pairs: list) -> None:
    """All maximal pairs of one stretch of the suffix order; ``common[i]`` is that of i and i + 1."""
    stack: list[_Interval] = []
    for i, place in enumerate(places):
        after = common[i] if i < len(common) else 0
        child = [place]
        while stack and stack[-1].length > after:
            top = stack.pop()
            _merge(top, child, left, times, pairs)
            child = top.places
        if after == 0:
            break
        if stack and stack[-1].length == after:
            _merge(stack[-1], child, left, times, pairs)
        else:
            stack.append(_Interval(after, child))


def maximal_pairs(symbols: np.ndarray, longest: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """``(i, j, length)`` of the maximal pairs of ``symbols`` that are runs."""
    # A run of period q has a pair of at least (times - 1) * q words; the shortest is for q = 1.
    shortest = max(times - 1, min(max(least, times * q) - q for q in range(1, least + 1)))
    order, levels = _names(symbols, longest)
    n = len(symbols)
    # The distance to the next place of the same `short` words: no run there has a smaller period.
    k = min(len(levels) - 1, max(0, shortest.bit_length() - 1))
    short = levels[k]
    by_name = np.lexsort((np.arange(n), short[:n]))
    gap = np.full(n, n, np.int64)
    again = np.flatnonzero(short[by_name[1:]] == short[by_name[:-1]])
    gap[by_name[again]] = by_name[again + 1] - by_name[again]
    # Neighbours in the suffix order that may have enough in common.
    close = np.flatnonzero(short[order[1:]] == short[order[:-1]])
    common = np.zeros(n, np.int64)
    common[close] = _common(levels, order[close], order[close + 1])
    common[common < shortest] = 0
    inside = common > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    pairs: list[tuple[int, int, int]] = []
    if not len(edge):
        return pairs
    left = None
    begins, ends = edge[::2], edge[1::2]
    gaps = np.minimum(np.minimum.reduceat(gap[order], edge)[::2], gap[order[ends]])
    greatest = np.maximum.reduceat(common, edge)[::2]
    for begin, end, far, least_gap in zip(begins, ends, greatest, gaps):
        if least_gap * (times - 1) > far:
            continue  # no two places of it are within reach
        if left is None:
            left = [-1, *symbols[:-1].tolist()]
        _walk(order[begin : end + 1].tolist(), common[begin:end].tolist(), left, times, pairs)
    return pairs


def runs_of(texts: list[Words], least: int = LEAST_LENGTH, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of every text, by start, then period."""
    out: list[dict] = [{} for _ in texts]
    bounds = np.cumsum([0] + [len(w) for w in texts])
    if bounds[-1]:
        symbols = np.empty(bounds[-1], np.int64)
        base = 0
        for t, words in enumerate(texts):
            known: dict[bytes, int] = {}
            for i, word in enumerate(words, bounds[t]):
                symbols[i] = base + known.setdefault(word, len(known))
            base += len(known)
        found = maximal_pairs(symbols, int(np.diff(bounds).max()), least, times)
        owners = np.searchsorted(bounds, [i for i, _, _ in found], side="right") - 1
        for t, (i, j, length) in zip(owners.tolist(), found):
            period = j - i
            stretch = (i - int(bounds[t]), length + period)
            if stretch[1] >= max(least, times * period):
                out[t][stretch] = min(period, out[t].get(stretch, period))
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in out]


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(
    docs: DataFrame, least: int = LEAST_LENGTH, times: int = TIMES,
    derive: Callable[[int | None, Words], Words] | None = None,
) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row, without a shuffle.

    A run has at least ``times`` periods and ``least`` words. ``derive`` may replace the words of a
    row before they are searched.
    """
    if times < 3 or least < 1:
        raise ValueError("a run has three periods at least, and a word")

    def rows(ids: list, texts: list[Words]) -> pa.RecordBatch:
        runs = runs_of(texts, least, times)
        kept = [b" ".join(collapsed(w, r)) for w, r in zip(texts, runs)]
        listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(listed, pa.list_(_RUN)),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    id_type = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        for batch in small_batches(batches):
            id_type = batch.schema.field("doc_id").type
            ids, texts, held = [], [], 0
            both = zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")))
            for doc_id, text in both:
                words = text.split()
                if derive:
                    words = derive(doc_id, words)
                if texts and held + len(words) > TOGETHER:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if ids:
                yield rows(ids, texts)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def repeat_some(doc_id: int | None, words: Words) -> Words:
    """The words of a document in ten made periodic from some place on, as its id says."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    pattern = words[begin : begin + period]
    times = -(-(n - begin) // period)
    return words[:begin] + (pattern * times)[: n - begin]


def _longest(field: str) -> Column:
    """A field of the run of greatest length, then smallest start, then smallest period."""
    ranked = F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return best[field] if field == "length" else -best[field]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), derive=repeat_some)
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), _longest("start").alias("start"),
        _longest("length").alias("length"), _longest("period").alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    exponent = F.expr("1000 * length div period")
    return best.select(
        "doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
