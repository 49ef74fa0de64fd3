"""Centroid clustering: integer k-means whose nearest centroid is found by a threshold algorithm.

For every dimension the centroids are kept in a list sorted by their coordinate. A vector enters
each list at its own coordinate and walks outward, always to the nearer of the two ends. Every
centroid met for the first time is compared exactly. The squared steps of all lists to where they
have got add up to a bound that no centroid still unmet can be below; a vector stops when that sum
strictly exceeds its best exact distance, so that ties still go to the smaller number.

Components are whole numbers, floor(scale * x), so sums, means and distances are exact and do not
depend on how the rows are dealt out. Each round is one pass over the vectors: a task adds up the
vectors of its clusters and hands on one row for each, and the driver sees one row for each
cluster. Rounds end early when no centroid moves, since all later ones would repeat it.

Vectors are left out that are null, of another length, or hold a null, NaN or infinite component,
or one beyond ``BOUND`` after scaling (its squared distances would leave a long). Vectors of equal
id or equal content count each; the start takes the smallest digests, then contents; rows without an
id start last. With fewer vectors than centroids there are as many centroids as vectors, and an
empty table gives no rows. Columns other than ``vec_id`` and ``embedding`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import stored, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, 3
#: Greatest scaled component: 64 squares of twice as much fit a long.
BOUND = 2**27
#: Vectors compared at once in a task.
BLOCK = 4096


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row of ``x`` (whole numbers)."""
    (n, dims), k = x.shape, len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable").T  # by dimension: numbers, then values
    values = np.take_along_axis(centroids.T, order, axis=1)
    number, distance = np.full(n, k, np.int32), np.full(n, np.iinfo(np.int64).max)
    met = np.zeros((n, k), bool)
    above = np.stack([np.searchsorted(values[d], x[:, d]) for d in range(dims)], axis=1)
    below = above - 1
    active, column = np.arange(n), np.arange(dims)
    while len(active):
        at, up, down = x[active], above[active], below[active]
        far = np.iinfo(np.int64).max
        to_up = np.where(up < k, values[column, np.minimum(up, k - 1)] - at, far)
        to_down = np.where(down >= 0, at - values[column, np.maximum(down, 0)], far)
        downward = to_down <= to_up
        step = np.where(downward, to_down, to_up)
        found = order[column, np.where(downward, np.maximum(down, 0), np.minimum(up, k - 1))]
        above[active], below[active] = up + ~downward, down - downward
        fresh = np.zeros((len(active), k), bool)
        fresh[np.arange(len(active))[:, None], found] = True
        fresh &= ~met[active]
        for j in np.flatnonzero(fresh.any(axis=0)):
            rows = active[fresh[:, j]]
            exact = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
            better = (exact < distance[rows]) | ((exact == distance[rows]) & (j < number[rows]))
            number[rows[better]], distance[rows[better]] = j, exact[better]
        met[active] |= fresh
        frontier = (step**2).sum(axis=1)
        active = active[(frontier <= distance[active]) & ~met[active].all(axis=1)]
    return number, distance


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            whole = part.column(part.schema.get_field_index("components")).flatten()
            yield part, whole.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """A task's rows ``cluster, n, sums``, one for each cluster that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)

        def row_batch() -> pa.RecordBatch:
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(count[some]),
                 pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        for _, x in _blocks(batches, dims):
            number, _ = nearest(x, centroids)
            rows = np.argsort(number, kind="stable")
            some, begins = np.unique(number[rows], return_index=True)
            total[some] += np.add.reduceat(x[rows], begins, axis=0)
            count += np.bincount(number, minlength=k)
            if count.sum() > 2**34:  # sums stay within a long
                yield row_batch()
                total[:], count[:] = 0, 0
        if count.any():
            yield row_batch()

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, centroids.shape[1]):
            number, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("vec_id")), pa.array(number), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, components`` (array<int>) of the vectors that take part."""
    fits = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) * scale < BOUND, F.lit(False)))
    kept = vectors.select("vec_id", "embedding").filter((F.size("embedding") == dims) & fits)
    return kept.select("vec_id", F.transform(
        "embedding", lambda v: F.floor(v.cast("double") * scale).cast("int")
    ).alias("components"))


def first_centroids(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    """The vectors of smallest digest; ``k`` rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "components").limit(k).select("components").collect()
    return np.array([r[0] for r in rows], np.int64)


def refine(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds; each brings one row for each cluster to the driver."""
    dims = centroids.shape[1]
    for _ in range(rounds):
        parts = vectors.select("components").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        exact = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        after = centroids.copy()
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
            after[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dims)]
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def centroid_clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS,
    scale: int = SCALE, salt: int = SALT,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the centroids."""
    whole = stored(whole_vectors(vectors, dims, scale), "vectors")
    centroids = first_centroids(whole, k, salt)
    schema = f"vec_id {dict(whole.dtypes)['vec_id']}, cluster int, distance long"
    if len(centroids) == 0:
        return whole.sparkSession.createDataFrame([], schema), np.empty((0, dims), np.int64)
    centroids = refine(whole, centroids, rounds)
    return whole.mapInArrow(_assigned(centroids), schema), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    assigned = stored(assigned, "clusters")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    everything = sums.agg(F.sum("part").alias("whole"))
    totals = named.join(sums, "cluster").join(F.broadcast(everything)).select(
        "cluster", F.col("part").cast("long").alias("cluster_inertia"),
        F.col("whole").cast("long").alias("inertia"), "centroid_sha256",
    )
    # One row for each of the few clusters.
    return assigned.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql() -> str:
    """Lloyd's rounds spelled out; the nearest centroid comes from all distances."""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c
  FROM (SELECT x, sha256('{SALT}:' || vec_id) AS h FROM v ORDER BY h, x LIMIT {CLUSTERS}))"""]
    near = """SELECT r, min(vec_id) AS vec_id, min(d) AS d, CAST(arg_min(j, d * 1000 + j) AS INTEGER) AS j FROM (
  SELECT r, vec_id, j, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM v, c{t}) GROUP BY r"""
    for t in range(ROUNDS):
        steps.append(f"""a{t} AS MATERIALIZED ({near.format(t=t)}),
s{t} AS (SELECT j, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT a{t}.j, unnest(range({DIMENSIONS})) AS i, unnest(v.x) AS y FROM a{t} JOIN v USING (r)) GROUP BY j, i),
m{t} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON c{t}.j = m{t}.j)""")
    steps.append(f"z AS MATERIALIZED ({near.format(t=ROUNDS)})")
    return ",\n".join(steps) + f"""
SELECT vec_id, z.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} AS c ON z.j = c.j
"""


OP13_SQL = _sql()
