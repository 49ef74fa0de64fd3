"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics (shares of kinds of
characters and words, repetition). Each class has a mean and a covariance, shrunk towards the pooled
covariance and its diagonal; its Cholesky factor is computed once and travels with the job. The
score is the logistic of the difference of the two log densities and log priors.

The moments are sums over all labelled rows outside the held-out third, formed in the tasks:
what reaches the driver is one row of a few hundred sums for each class.

Null and empty texts have statistics like any other text. Labels of null quality are not used;
an id with several labels counts once for each. Without labels of both classes every score is
0.5. Every row of the input gives one row, repeated rows too; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import as_bytes, drop_stored, held_out, small_batches, stored, table

STATISTICS = (
    "upper", "digits", "marks", "odd_marks", "bars", "stops", "repeated_words", "repeated_pairs",
    "repeated_lines", "short_words", "shout_words",
)
#: Added to every length before a share is taken: short texts then look unremarkable.
STEADY = 60
SHRINK, TO_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
UPPER, DIGIT = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")
MARK, ODD, STOP = re.compile(rb"[!-/:-@\[-`{-~]"), re.compile(rb"[#$%&*@^~=<>_\\]"), re.compile(rb"[.!?]")
SHOUT = re.compile(rb"[A-Z]{2,}")


def statistics(text: bytes) -> list[float]:
    """Statistics of one text: square roots of steadied shares, which spread their small values."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m, k = len(text), len(words), len(lines)
    pairs = set(zip(words, words[1:], strict=False))
    parts = [
        (len(UPPER.findall(text)), n), (len(DIGIT.findall(text)), n), (len(MARK.findall(text)), n),
        (len(ODD.findall(text)), n), (text.count(b"|"), n), (len(STOP.findall(text)), m),
        (m - len(set(words)), m), (max(0, m - 1 - len(pairs)), m), (k - len(set(lines)), k),
        (sum(1 for w in words if len(w) <= 3), m), (len(SHOUT.findall(text)), m),
    ]
    return [(part / (whole + STEADY)) ** 0.5 for part, whole in parts]


@dataclass
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors, and log prior minus half log determinant."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        logs = []
        for mean, whiten, offset in zip(self.means, self.whiten, self.offsets, strict=True):
            z = (x - mean) @ whiten.T
            logs.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | None:
    """From the count, sums and sums of products of class 0 and class 1."""
    if (counts < 1).any():
        return None
    means = sums / counts[:, None]
    spread = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = spread.sum(0) / counts.sum()
    scale = np.diag(pooled).mean() or 1.0
    whiten, offsets = [], []
    for k in (0, 1):
        own = (1 - SHRINK) * spread[k] / counts[k] + SHRINK * pooled
        own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own))
        factor = np.linalg.cholesky(own + RIDGE * scale * np.eye(len(own)))
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(offsets))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the array ``x`` of statistics of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = [statistics(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    plain = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return plain.mapInArrow(measure, "doc_id long, x array<double>")


def learn(measured: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on all rows of ``measured`` with a label and outside the held-out third."""
    p = len(STATISTICS)
    marked = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            y = np.array(batch.column("quality").to_pylist())
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, p)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)),
             pa.array(total.ravel())], names=["k", "i", "v"],
        )

    sums = measured.join(marked, "doc_id").select("x", "quality").mapInArrow(moments, "k long, i long, v double")
    total = np.zeros((2, 1 + p + p * p))
    for row in sums.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():  # 2 (1 + p + p^2) rows
        total[row["k"], row["i"]] = row["v"]
    return fit(total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(2, p, p))


def scored(measured: DataFrame, model: Discriminant | None) -> DataFrame:
    """``doc_id, score`` of every row of ``measured``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    measured = stored(with_statistics(docs), "statistics")
    return scored(measured, learn(measured, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns.

    The model is fitted first; texts are then measured again where they lie, so that no text is
    shuffled.
    """
    measured = stored(with_statistics(docs), "statistics")
    model = learn(measured, labels)
    drop_stored(measured)
    names = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = as_bytes(batch.column(names.index("text")))
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            keep = model.score(x) >= 0.5 if model else np.ones(len(x), bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(judge, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
