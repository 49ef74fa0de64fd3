"""Line dedup, periodic runs and centroid clustering against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from spanforge.llm import centroids, line_dedup, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")
LINE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    # Names that the operator uses inside.
    T.StructField("kid", T.StringType()), T.StructField("places", T.StringType()),
    T.StructField("lines", T.StringType()), T.StructField("h1", T.StringType()),
])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- line dedup -------------------------------------------------------------------------------

def line_rows():
    rng = random.Random(11)
    common = ["All rights reserved by the owner.", "  \tSubscribe to our NEWSLETTER now\r", "Ünder Äll Circumstances zählt das",
              "ünder äll circumstances zählt das", "short line", "x" * 19, "y" * 20, "", "   ", " padded by another blank "]
    rows = [(None, common[0]), (None, common[0] + "\n" + common[1]), (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"),
            (5, common[0] + "\n" + common[0]), (6, common[0].upper()), (6, common[0].upper()), (7, "a\n" * 3000 + common[0])]
    for i in range(10, 120):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"line {rng.randrange(60)} of some documents" for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    rows.append((500, "\n".join(rng.choice(common) for _ in range(20000))))
    # One hot line in most documents, and one row repeated.
    rows += [(i, f"only here {i} and nowhere else\nThe very common line of this table") for i in range(600, 900)]
    return rows + [(901, common[0] + "\nThe very common line of this table")] * 3


def lines_by_brute_force(rows, least_chars=20, least_docs=3):
    def key(line):
        bare = line.strip(" \t\n\x0b\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(-math.inf if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -math.inf if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least_chars,least_docs", [(20, 3), (1, 2)])
def test_line_dedup(spark, least_chars, least_docs):
    rows = line_rows()
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], LINE).repartition(5)
    got = line_dedup.line_dedup(df, least_chars, least_docs).collect()
    expected = lines_by_brute_force(rows, least_chars, least_docs)
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert any(n for _, _, n, _ in expected)


def test_lines_that_are_not_hot_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)  # one in twenty lines: some are, some are not
    rows = line_rows()
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], LINE)
    got = line_dedup.line_dedup(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(lines_by_brute_force(rows), key=repr)


def test_line_dedup_of_empty_table(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], LINE)).collect() == []


# ---- periodic runs ----------------------------------------------------------------------------

def runs_by_brute_force(words, least=6, times=4):
    out = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def repetitive_words(rng):
    words = [b"%d" % rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(0, 60))]
    if words and rng.random() < 0.5:
        part = words[: rng.randrange(1, 6)]
        words += part * rng.randrange(1, 9) + words[:5]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (3, 3), (1, 4), (20, 5)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(300):
        texts = [repetitive_words(rng) for _ in range(rng.randrange(1, 6))]
        assert periodic_runs.runs_of(texts, least, times) == [runs_by_brute_force(w, least, times) for w in texts]


def test_runs_of_long_texts():
    """Long and very repetitive texts take no more than about n log^2 n steps."""
    assert periodic_runs.runs_of([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    table = [x for i in range(20_000) for x in (b"%d" % i, b"-", b"-", b"-", b"-", b"-")]
    assert periodic_runs.runs_of([table]) == [[]]
    table = [x for i in range(20_000) for x in (b"%d" % i, *[b"-"] * 6)]
    assert periodic_runs.runs_of([table]) == [[(7 * i + 1, 6, 1) for i in range(20_000)]]
    once = [b"%d" % i for i in range(20_000)]
    assert periodic_runs.runs_of([[b"x", *once * 4, b"0", b"y"]]) == [[(1, 80_001, 20_000)]]


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_brute_force(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \n\t"), (4, "la " * 7 + "end"), (4, "la " * 7 + "end"),
            (5, "one two three"), (6, "a b " * 8 + "c d " * 8), (7, "\u0085 \u0085 " * 5)]
    for i in range(10, 160):
        rows.append((i, " ".join(w.decode() for w in repetitive_words(rng))))
    rows += [(i, " ".join(str(rng.randrange(500)) for _ in range(rng.randrange(200)))) for i in range(160, 300)]
    extra = "doc_id long, text string, runs string, start string, collapsed string"
    spark.createDataFrame([(*r, "r", "s", "c") for r in rows], extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected_runs(*r) for r in rows), key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_batches_of_runs(spark, monkeypatch):
    """Texts that share words do not meet, wherever a batch is cut."""
    texts = [[b"a", b"b"] * n for n in range(1, 9)]
    assert periodic_runs.runs_of(texts) == [runs_by_brute_force(w) for w in texts]
    assert periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([[], []]) == [[], []]


# ---- centroid clustering ----------------------------------------------------------------------

def clusters_by_brute_force(rows, k=8, rounds=10, dims=64):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [math.floor(1024 * v) for v in x]))
    first = sorted((vec_id is None, sha(f"3:{vec_id}"), x) for vec_id, x in kept)[:k]
    middle = [x for _, _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for j, group in groups.items():
            middle[j] = [sum(v) // len(group) for v in zip(*group)]
    placed = [(vec_id, *reversed(near(x))) for vec_id, x in kept]
    total = sum(d for _, _, d in placed)
    return [
        (vec_id, j, d, sum(e for _, i, e in placed if i == j), total, sha(",".join(map(str, middle[j]))))
        for vec_id, j, d in placed
    ]


def vector_rows(rng, n=400):
    hot = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(None, hot), (None, hot), (1, None), (2, []), (3, hot[:-1]), (4, [*hot[:-1], None]), (5, [*hot[:-1], math.nan]),
            (6, [*hot[:-1], math.inf]), (7, [0.0] * 64), (7, [0.0] * 64), (7, [-0.5] * 64)]
    rows += [(i, hot) for i in range(10, 80)]
    return rows + [(i, [rng.choice([-1, 0, 1]) + rng.uniform(-0.2, 0.2) for _ in range(64)]) for i in range(100, 100 + n)]


def test_centroids_query(spark, tmp_path):
    rows = vector_rows(random.Random(7))
    extra = "vec_id long, embedding array<double>, cluster string, distance string, components string"
    spark.createDataFrame([(*r, "c", "d", "x") for r in rows], extra).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op13_centroids(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(clusters_by_brute_force(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)], [(i, [0.0] * 64) for i in range(20)]])
def test_centroids_of_few_vectors(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op13_centroids(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(clusters_by_brute_force(rows), key=repr)


def test_components_beyond_the_bound(spark):
    rows = [(1, [1e30] * 64), (2, [centroids.BOUND / 1024] * 64), (3, [centroids.BOUND / 1024 - 1] * 64)]
    kept = centroids.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [r["vec_id"] for r in kept.collect()] == [3]


@pytest.mark.parametrize("k,dims", [(1, 3), (8, 64), (200, 5)])
def test_threshold_algorithm(k, dims):
    """The walk finds the nearest of all centroids, with ties to the smaller number."""
    rng = np.random.default_rng(k)
    x, c = rng.integers(-6, 7, (3000, dims)), rng.integers(-6, 7, (k, dims))
    number, distance = centroids.nearest(x, c)
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
