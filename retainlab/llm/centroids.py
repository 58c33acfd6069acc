"""Centroid clustering whose assignment walks sorted lists (threshold algorithm).

The centroids of a round are kept, per dimension, in a list sorted by value.
A vector enters every list at its own value and walks outward: each step takes
the next nearest entry of each list, and centroids met for the first time get
their exact distance. The entries last taken bound what is still unmet: once
the sum of their squared distances strictly exceeds the best exact distance, no
unmet centroid can be nearer or tie, and the walk of that vector stops. A task
walks a slice of vectors at a time.

The integer vectors are written once to the shared folder. A round sums its
vectors per centroid inside the task, so what is shuffled is one row per task,
centroid and dimension, however many vectors one centroid holds; the driver
holds the centroids alone (``k`` rows).

Rows whose vector is null, of another length, or holds null or non-finite
components are left out. Repeated rows count as often as they occur. Vectors
with a null id come last when starting centroids are chosen, equal ids are
chosen in the order of their vectors. With fewer than ``k`` vectors each is a
centroid; an empty table gives no rows. Components beyond 2**21 in size have no
exact 64-bit distances and are an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, remove_stage, write_stage
from .vectors import integer_rows, lists, matrix

FAR = np.iinfo(np.int64).max
#: Vectors walked at a time: bounds a task's scratch matrices.
SLICE = 512


class SortedLists:
    """Centroids in one list per dimension, sorted by value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.numbers = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.numbers, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per vector: nearest centroid (ties: the smaller number), squared
        distance, and the steps walked down the lists."""
        n, (k, dims) = len(x), self.centroids.shape
        best, who, depth = np.full(n, FAR), np.full(n, k), np.zeros(n, dtype=np.int64)
        up = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in range(dims)], axis=1)
        down, seen = up - 1, np.zeros((n, k), dtype=bool)
        column, walking = np.arange(dims), np.arange(n)
        for _ in range(k):
            if not len(walking):
                break
            at, lo, hi = x[walking], down[walking], up[walking]
            below = np.where(lo >= 0, at - self.values[np.maximum(lo, 0), column], FAR)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), column] - at, FAR)
            left = below <= above
            met = self.numbers[np.where(left, lo, hi), column]
            down[walking], up[walking] = lo - left, hi + ~left
            fresh = np.zeros((len(walking), k), dtype=bool)
            fresh[np.arange(len(walking))[:, None], met] = True
            fresh &= ~seen[walking]
            seen[walking] |= fresh
            row, c = np.nonzero(fresh)
            exact = np.full(fresh.shape, FAR)
            exact[row, c] = ((at[row] - self.centroids[c]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)
            least = exact[np.arange(len(walking)), first]
            better = (least < best[walking]) | ((least == best[walking]) & (first < who[walking]))
            best[walking[better]], who[walking[better]] = least[better], first[better]
            depth[walking] += 1
            frontier = (np.minimum(below, above) ** 2).sum(axis=1)
            walking = walking[frontier <= best[walking]]
        return who, best, depth


def _slices(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column("vec_id"), matrix(part.column("x"), dims)


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every integer vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SortedLists(centroids)
        for ids, x in _slices(batches, centroids.shape[1]):
            who, best, _ = index.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long")


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of the vectors nearest to each centroid, exact;
    a centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SortedLists(centroids)
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, x in _slices(batches, dims):
            who, _, _ = index.nearest(x)
            n += np.bincount(who, minlength=k)
            sums += (who == np.arange(k)[:, None]).astype(np.int64) @ x
        held = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), lists(sums[held], pa.int64())], names=["cluster", "n", "sums"])

    parts = kept.mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = (
        parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
        .groupBy("cluster", "dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
        .collect()  # k x dims rows
    )
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster_vectors(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """Every clean vector with its cluster, squared distance, the inertia of
    its cluster and of all, and a digest of its centroid. Start: the ``k``
    vectors with the smallest sha256 of ``<seed>:<vec_id>``."""
    kept = write_stage(spark, integer_rows(vectors, dims), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r["x"] for r in start], dtype=np.int64).reshape(len(start), dims)
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    assigned = write_stage(spark, assign(kept, centroids), "assigned")
    remove_stage(spark, kept)
    inertia = {r["cluster"]: r["i"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame(
        [(c, i, total, digest[c]) for c, i in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )  # at most k rows
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean vectors of ``embeddings`` in 16 clusters after three rounds."""
    return cluster_vectors(spark, load(spark, sf_dir, "embeddings"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, c, distance FROM (
    SELECT k.r, k.vec_id, k.x, c.c,
           list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance,
           row_number() OVER (PARTITION BY k.r ORDER BY distance, c.c) AS nth
    FROM kept k, c{i} c) WHERE nth = 1),
s{i} AS (SELECT c, d, sum(v) AS s, count(*) AS n
         FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM a{i}) GROUP BY c, d),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS x FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c))"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM kept
  ORDER BY sha256('1:' || vec_id) NULLS LAST, x LIMIT 16),
{",".join(_round_sql(i) for i in range(4))}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 f USING (c)
"""
