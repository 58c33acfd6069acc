"""Reading embedding columns inside tasks: clean rows as integer matrices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Largest |x| whose squared distances over 64 components stay below 2**63.
FAR_OFF = 1 << 27


def clean(batch: pa.RecordBatch, dims: int, scale: float = 64.0) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * component) as an int64 matrix of the rows whose
    vector has ``dims`` components, none of them null or non-finite."""
    ids, vecs = batch.column("vec_id"), batch.column("embedding")
    keep = pc.fill_null(pc.equal(pc.list_value_length(vecs), dims), False)
    ids, vecs = ids.filter(keep), vecs.filter(keep)
    flat = pc.list_flatten(vecs).cast(pa.float64())
    m = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dims)  # nulls are NaN
    finite = np.isfinite(m).all(axis=1)
    x = np.floor(scale * m[finite])
    if x.size and np.abs(x).max() > FAR_OFF:
        raise OverflowError(f"vector components beyond {FAR_OFF / scale:g} have no exact 64-bit distances")
    return ids.filter(pa.array(finite)), x.astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of equally long lists without nulls as a matrix."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), dims)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    ends = np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)[: len(m) + 1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel(), type=kind))


def integer_rows(vectors: DataFrame, dims: int, add: int = 0) -> DataFrame:
    """(vec_id, x): clean vectors as integers floor(64 * component) + ``add``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = clean(batch, dims)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), lists(x + add, pa.int64())], names=["vec_id", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x array<long>")
