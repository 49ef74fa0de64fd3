"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent units read each stretch of 128 bytes, one from either end; both states at a
byte give the probabilities of that byte's language, and a document's probabilities are their
mean over all its bytes. Whole texts are labelled, stretch by stretch, thousands of stretches
side by side in numpy.

The network is trained in numpy by back-propagation through time on the driver, on a bounded
sample: at most ``SAMPLE`` rows of each language, those with the smallest hashes, none from the
held-out third (ids with crc32 mod 3 = 1). Of a text beyond ``SAMPLE_CHARS`` characters it takes that
many, in stretches at hashed places of the whole text.

A null text, or one without a letter, is ``und`` with score 0. Rows with null language teach
nothing; without any labelled row everything is ``und``. Repeated rows are answered as often
as they come, and equal texts get equal answers; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import held_out, small_batches, table

SAMPLE, SAMPLE_CHARS = 150, 4096
HIDDEN, STRETCH, LANES = 8, 128, 4096
STEPS, BATCH, LEARN_LENGTH, RATE = 240, 128, 64, 0.02


@dataclass
class Network:
    """For each direction: input table (3H, 256), recurrent matrix (3H, H); output (C, 2H) and offsets."""

    languages: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    offset: np.ndarray


def _gates(given: np.ndarray, old: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sigmoid gates, and the candidate state, from inputs and recurrent sums."""
    k = len(h)
    both = np.tanh(0.5 * (given[: 2 * k] + old[: 2 * k])) * np.float32(0.5) + np.float32(0.5)
    return both, np.tanh(given[2 * k :] + both[k:] * old[2 * k :])


def _states(table: np.ndarray, recurrent: np.ndarray, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """States after each step, (T, H, B), of one unit that reads ``data`` (T, B) downwards."""
    k = recurrent.shape[1]
    half = np.repeat(np.array([0.5, 1], np.float32), [2 * k, k])[:, None]  # for sigmoid by tanh
    rows, recurrent = np.ascontiguousarray((table * half).T), recurrent * half
    lanes = data.shape[1]
    h = np.zeros((k, lanes), np.float32)
    out = np.empty((len(data), k, lanes), np.float32)
    given, old = np.empty((3 * k, lanes), np.float32), np.empty((3 * k, lanes), np.float32)
    both, new, looked_up = given[: 2 * k], given[2 * k :], np.empty((lanes, 3 * k), np.float32)
    for t, column in enumerate(data):  # in place: this loop runs once for every byte of a stretch
        np.take(rows, column, axis=0, out=looked_up, mode="clip")
        np.copyto(given, looked_up.T)
        np.matmul(recurrent, h, out=old)
        both += old[: 2 * k]
        np.tanh(both, out=both)
        both *= np.float32(0.5)
        both += np.float32(0.5)
        old[2 * k :] *= both[k:]
        new += old[2 * k :]
        np.tanh(new, out=new)
        h = out[t]
        np.subtract(out[t - 1] if t else 0, new, out=h)
        h *= both[:k]
        h += new
        if mask is not None:
            h *= mask[t]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def label_bytes(net: Network, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Sum over the unmasked steps of the probabilities, (C, B), for byte columns (T, B)."""
    ahead = _states(net.table[0], net.recurrent[0], data, mask)
    back = _states(net.table[1], net.recurrent[1], data[::-1], None if mask is None else mask[::-1])[::-1]
    p = net.output[:, :HIDDEN] @ ahead
    p += net.output[:, HIDDEN:] @ back
    p += net.offset[:, None]
    np.exp(np.minimum(p, 60, out=p), out=p)
    p /= p.sum(1, keepdims=True)
    return (p if mask is None else p * mask).sum(0)


def _backward(table: np.ndarray, u: np.ndarray, data: np.ndarray, states: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent matrix through time."""
    k = u.shape[1]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    dh = np.zeros_like(states[0])
    for t in range(len(data) - 1, -1, -1):
        h = states[t - 1] if t else np.zeros_like(dh)
        old = u @ h
        both, new = _gates(np.take(table, data[t], axis=1), old, h)
        z, r = both[:k], both[k:]
        d = d_states[t] + dh
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * old[2 * k :] * r * (1 - r)
        d_old = np.concatenate([d_z, d_r, d_new * r])
        d_in = np.concatenate([d_z, d_r, d_new])
        for row in range(3 * k):
            d_table[row] += np.bincount(data[t], weights=d_in[row], minlength=256)
        d_u += d_old @ h.T
        dh = d * z + u.T @ d_old
    return d_table, d_u


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> Network | None:
    """Fit the network to byte stretches drawn from ``samples`` (language, text)."""
    by_language: dict[str, list[np.ndarray]] = {}
    for language, text in samples:
        if text:
            by_language.setdefault(language, []).append(np.frombuffer(text, np.uint8))
    languages = sorted(by_language)
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    k, c = HIDDEN, len(languages)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    p = [draw(3 * k, 256), draw(3 * k, 256), draw(3 * k, k), draw(3 * k, k), draw(c, 2 * k), np.zeros(c, np.float32)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, STEPS + 1):
        data = np.empty((LEARN_LENGTH, BATCH), np.uint8)
        y = rng.integers(0, c, BATCH)
        for lane in range(BATCH):
            texts = by_language[languages[y[lane]]]
            text = texts[rng.integers(len(texts))]
            at = rng.integers(max(1, len(text) - LEARN_LENGTH + 1))
            data[:, lane] = np.resize(text[at : at + LEARN_LENGTH], LEARN_LENGTH)
        ahead = _states(p[0], p[2], data, None)
        back = _states(p[1], p[3], data[::-1], None)[::-1]
        both = np.concatenate([ahead, back], axis=1)
        logits = np.einsum("ck,tkb->ctb", p[4], both) + p[5][:, None, None]
        d = _softmax(logits)
        d[y, :, np.arange(BATCH)] -= 1
        d /= d[0].size
        d_both = np.einsum("ck,ctb->tkb", p[4], d)
        grads: list[np.ndarray] = [None] * 6
        grads[0], grads[2] = _backward(p[0], p[2], data, ahead, d_both[:, :k])
        grads[1], grads[3] = _backward(p[1], p[3], data[::-1], back[::-1], d_both[::-1, k:])
        grads[4], grads[5] = np.einsum("ctb,tkb->ck", d, both), d.sum((1, 2))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            change = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            p[i] = (p[i] - rate * change).astype(np.float32)
    return Network(languages, [p[0], p[1]], [p[2], p[3]], p[4], p[5])


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities, (number of texts, C), over all bytes of each text."""
    lanes: list[tuple[int, int]] = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), STRETCH)]
    total = np.zeros((len(texts), len(net.languages)))
    # Full stretches first: only the short ones at the end need a mask.
    lanes.sort(key=lambda lane: len(texts[lane[0]]) - lane[1] < STRETCH)
    for begin in range(0, len(lanes), LANES):
        group = lanes[begin : begin + LANES]
        pieces = [texts[i][at : at + STRETCH] for i, at in group]
        lengths = np.array([len(x) for x in pieces])
        longest = int(lengths.max())
        data = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in pieces), np.uint8).reshape(-1, longest).T
        mask = None
        if lengths.min() < longest:
            mask = (np.arange(longest)[:, None] < lengths).astype(np.float32)[:, None, :]
        sums = label_bytes(net, np.ascontiguousarray(data), mask)
        np.add.at(total, [i for i, _ in group], sums.T)
    return total / np.maximum([[len(t)] for t in texts], 1)


def _sampled_characters(text: Column) -> Column:
    """The text, or of a long one stretches at hashed places all over it."""
    length, stretches = F.char_length(text), SAMPLE_CHARS // STRETCH
    places = F.transform(
        F.sequence(F.lit(0), F.lit(stretches - 1)),
        lambda i: text.substr(
            (F.pmod(F.xxhash64("doc_id", i), length - STRETCH + 1) + 1).cast("int"), F.lit(STRETCH)
        ),
    )
    return F.when(length <= SAMPLE_CHARS, text).otherwise(F.array_join(places, ""))


def training_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """At most ``SAMPLE`` rows of each language, the same ones on every run."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "part")
    chosen = usable.select("lang", "doc_id", _sampled_characters(F.col("text")).alias("part")).withColumn(
        "place", F.row_number().over(order)
    ).filter(F.col("place") <= SAMPLE)
    return [(r["lang"], r["part"].encode()) for r in chosen.orderBy("lang", "place").collect()]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2_000_000):
            texts = batch.column("text").to_pylist()
            spoken = [i for i, t in enumerate(texts) if net and t is not None and any(map(str.isalpha, t))]
            languages, scores = ["und"] * len(texts), [0.0] * len(texts)
            if spoken:
                p = pooled(net, [texts[i].encode() for i in spoken])
                for i, best, score in zip(spoken, p.argmax(1), p.max(1), strict=True):
                    languages[i], scores[i] = net.languages[best], min(1.0, float(score))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    plain = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return plain.mapInArrow(label, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learnt from the rows themselves."""
    found = identify(docs, train(training_sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
