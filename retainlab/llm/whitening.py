"""Embedding whitening with Spark MLlib's distributed BlockMatrix.

1. Clean vectors become integers and are written once to the shared folder;
   rows are numbered 0, 1, ... by the counts of the written parts.
2. Exact integer column sums come from one row per task. Rows are centred,
   indexed and cut into blocks of ``ROWS`` rows (``IndexedRowMatrix``,
   ``BlockMatrix``). The scatter is transpose times matrix with the long middle
   dimension split, so a task multiplies a few blocks and what meets in one
   place are dims x dims partial sums.
3. ``numpy.linalg.eigh`` on the dims x dims covariance gives the components;
   the matrix of components over root eigenvalues is one small block, and
   BlockMatrix multiplication by it projects all rows.
4. The projected rows are written; the same scatter over them, centred anew,
   gives the distance of their covariance from the identity.

MLlib's block product keeps the keys of all blocks on the driver: one pair of
ints for each ``ROWS`` rows (10**9 rows: 122,071 pairs), no rows. Its product
with a split middle dimension has no Python wrapper and is called on the Java
matrix; so is the conversion of rows to a DataFrame.

Rows whose vector is null or holds null or non-finite components are left out.
``dims`` is the commonest length among vectors (ties: the greater); vectors of
another length have no coordinates in that space and are left out too. Repeated
rows count, and come out, as often as they occur. Components without variance
cannot be whitened: fewer than 32 come out if the covariance has a lower rank,
none for a single row or an empty table. A deviation beyond 64 bits and a
component beyond 2**21 are errors. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, write_stage
from .vectors import integer_rows, lists, matrix

#: Rows of a block: 4 MB of doubles at 64 dimensions.
ROWS = 8192
#: Blocks that one task of a scatter multiplies.
BLOCKS_A_TASK = 8
#: Added to every integer component.
BASE = 1_000_000


def numbered(rows: DataFrame) -> DataFrame:
    """A written table with the column ``index``: 0, 1, ... without gaps. Its
    column ``id`` holds monotonically increasing ids from the write."""
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row per written part
        rows.groupBy(part.alias("part"))
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    return rows.withColumn("part", part).join(starts, "part").withColumn("index", F.col("first") + at).drop("part", "first", "id")


def column_sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Count and exact sums of integer vectors, one row per task shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, dtype=np.int64)
        for b in batches:
            n += b.num_rows
            sums += matrix(b.column("x"), dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), lists(sums[None, :], pa.int64())], names=["n", "sums"])

    parts = rows.select("x").mapInArrow(run, "n long, sums array<long>")
    totals = (
        parts.select("n", F.posexplode("sums").alias("dim", "part"))
        .groupBy("dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
        .collect()  # dims rows
    )
    sums = {r["dim"]: int(r["total"]) for r in totals}
    return (totals[0]["n"] if totals else 0), np.array([sums.get(j, 0) for j in range(dims)], dtype=np.int64)


def centred(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """(index, vec_id, deviation, v): v = x - sums / n, rounded once, and the
    exact squared length of n * x - sums."""
    dims = len(sums)
    names = ["index", "vec_id", "deviation", "v"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = n * matrix(b.column("x"), dims) - sums
            if len(d) and (d.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**63:
                raise OverflowError("a deviation needs more than 64 bits")
            yield pa.RecordBatch.from_arrays(
                [b.column("index"), b.column("vec_id"), pa.array((d * d).sum(axis=1)), lists(d / n, pa.float64())], names=names
            )

    return rows.select("index", "vec_id", "x").mapInArrow(run, "index long, vec_id long, deviation long, v array<double>")


def blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Rows (index, v) as a distributed matrix, one block wide."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(ROWS, dims)


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, its middle dimension dealt over tasks."""
    tasks = -(-m.numRowBlocks // BLOCKS_A_TASK)
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, tasks)
    out = BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def project(m: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(index, v): every row of the matrix times the small ``weights``."""
    dims, k = weights.shape
    local = BlockMatrix(
        SparkSession.active().sparkContext.parallelize([((0, 0), Matrices.dense(dims, k, weights.ravel(order="F")))], 1), dims, k
    )
    rows = callMLlibFunc("getIndexedRows", m.multiply(local).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("v"))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are not rounding noise, falling, at most ``most``, and
    their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > max(values[0], 0.0) * len(values) * np.finfo(float).eps * 16).sum())
    return values[: min(most, real)], vectors[:, : min(most, real)]


def commonest_length(vectors: DataFrame) -> int:
    lengths = vectors.groupBy(F.size("embedding").alias("d")).count().filter("d > 0")
    top = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 1


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(spark: SparkSession, vectors: DataFrame, most: int = 32, dims: int | None = None) -> DataFrame:
    """Every clean row's whitened coordinates, one row per component."""
    dims = dims or commonest_length(vectors)
    kept = write_stage(spark, integer_rows(vectors, dims, BASE).withColumn("id", F.monotonically_increasing_id()), "integers")
    n, sums = column_sums(kept, dims)
    if n < 2:
        return spark.createDataFrame([], RESULT)
    rows = centred(numbered(kept), n, sums)
    m = blocks(rows, n, dims)
    covariance = scatter(m) / n
    values, vectors_ = components_of(covariance, most)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    k = len(values)
    white = write_stage(spark, project(m, vectors_ / np.sqrt(values)), "whitened")
    means = np.array(white.agg(*[F.avg(F.col("v")[j]) for j in range(k)]).first())
    again = white.select("index", F.transform("v", lambda c, i: c - F.array(*map(F.lit, means.tolist()))[i]).alias("v"))
    error = float(np.abs(scatter(blocks(again, n, k)) / n - np.eye(k)).max())
    shares = F.array(*map(F.lit, (values / np.trace(covariance)).tolist()))
    out = (
        rows.select("index", "vec_id", "deviation")
        .join(white, "index")
        .select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened"))
    )
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean vectors of ``embeddings`` on up to 32 whitened components."""
    return whiten(spark, load(spark, sf_dir, "embeddings"))
