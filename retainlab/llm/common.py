"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.session import scratch_path
from retainlab.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: few rows and few bytes at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


#: whether Spark deletes the shuffle files of a query as it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage,
    so that a lost executor costs tasks of one stage only. What was shuffled for
    it is deleted with it."""
    path = stage_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_stage(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a written table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def arrow_rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns of Arrow batches as Python values."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def chunks(rows: Iterable[tuple], schema: pa.Schema, limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Python rows as Arrow batches of at most ``limit`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of one buffer, by one
    cumulative polynomial sum: equal bytes give equal hashes anywhere."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def toggled(h: np.ndarray, of: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """A string of ``widths`` bits (a power of two) for each set: the bits that
    its hashes ``h`` toggle, ``of`` being the set of each hash."""
    start = np.cumsum(widths) - widths
    at = (h & (widths[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(start[of] + at, minlength=int(widths.sum())) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [data[i // 8 : (i + n) // 8] for i, n in zip(start.tolist(), widths.tolist(), strict=True)]


def apart(x: bytes, y: bytes) -> int:
    """Bits that differ in two strings of ``toggled``, the wider one folded. At
    least as many hashes are in one of the two sets alone."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), len(x)
    while size > len(y):
        size //= 2
        a = a >> 8 * size ^ a & (1 << 8 * size) - 1
    return (a ^ int.from_bytes(y, "little")).bit_count()


def near_pairs(met: DataFrame, limit: Callable[[int, int], int]) -> DataFrame:
    """The pairs ``a``, ``b`` (of sizes ``a_n``, ``b_n``) of which at most
    ``limit`` bits of ``a_wide`` and ``b_wide`` differ, or one of them is null."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows(batches, "a", "b", "a_n", "b_n", "a_wide", "b_wide")
        kept = ((a, b) for a, b, m, n, x, y in rows if x is None or y is None or apart(x, y) <= limit(m, n))
        yield from chunks(kept, schema)

    return met.select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(run, "a long, b long")
