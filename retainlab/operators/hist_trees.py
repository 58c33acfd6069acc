"""Binned training blocks and flat decision trees, shared by the boosted and
the randomised trees.

Features are binned once: cut points are quantiles of the training rows (all
distinct values where a feature has few), from one aggregate. Blocks of binned
rows stay cached on the executors; a step of a fit runs one job over them that
sums histograms, so the driver holds histograms and trees, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a cached block, and rows up to which one task holds them all: the jobs
#: of a step of a fit take longer than a task's sums over so many rows.
BLOCK_ROWS, TASK_ROWS = 65_536, 1 << 20

#: Rows from which on narrow features are summed up eight at a time. That adds in
#: another order, which decides between splits that are equally good.
PACK_ROWS = 16_384


# ------------------------------------------------------------------- trees
@dataclass
class Tree:
    """Flat nodes; a row goes left where x[feature] <= threshold. Leaves point
    to themselves, so that ``depth`` steps bring every row to its leaf."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        limit, flat, first = (self.cut if binned else self.threshold), x.ravel(), np.arange(len(x)) * x.shape[1]
        node = np.zeros(len(x), dtype=np.int32)
        for _ in range(self.depth):
            node = np.where(flat.take(first + self.feature[node]) <= limit[node], self.left[node], self.right[node])
        return node

    def predict(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return self.value[self.leaves(x, binned)]


class Growing:
    """A tree under construction. Splits may be tried before they are kept."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.depth = [-1], [0], [0], [0], [0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left = len(self.feature)
        for child in (left, left + 1):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(child)
            self.right.append(child)
            self.depth.append(self.depth[node] + 1)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, left + 1
        return left, left + 1

    def frozen(self, cuts: list[np.ndarray], value: dict[int, float], cover: dict[int, float], kept: set[int] | None = None) -> Tree:
        """Flat arrays; splits of nodes outside ``kept`` are taken back."""
        n = len(self.feature)
        split = np.array([self.feature[i] >= 0 and (kept is None or i in kept) for i in range(n)])
        feature = np.where(split, self.feature, 0).astype(np.int32)
        cut = np.where(split, self.cut, np.iinfo(np.int32).max).astype(np.int32)
        own = np.arange(n, dtype=np.int32)
        left, right = np.where(split, self.left, own).astype(np.int32), np.where(split, self.right, own).astype(np.int32)
        threshold = np.array([cuts[f][c] if s else np.inf for f, c, s in zip(feature, cut, split)])
        reached = _reachable(left, right)
        depth = max((self.depth[i] for i in reached), default=0)
        order = {old: new for new, old in enumerate(reached)}
        pick = np.array(reached)
        return Tree(
            feature[pick], cut[pick], threshold[pick],
            np.array([order[i] for i in left[pick]], dtype=np.int32), np.array([order[i] for i in right[pick]], dtype=np.int32),
            np.array([value.get(i, 0.0) for i in reached]), np.array([cover.get(i, 0.0) for i in reached]), int(depth),
        )


def _reachable(left: np.ndarray, right: np.ndarray) -> list[int]:
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        out.append(i)
        if left[i] != i:
            todo += [int(right[i]), int(left[i])]
    return out


# ------------------------------------------------------------------- bins
def feature_cuts(train: DataFrame, vec: str = "features", bins: int = 255) -> list[np.ndarray]:
    """Per feature the ascending cut points (a bin is x <= its cut), from one
    aggregate; a feature with at most ``bins`` values is cut at each of them."""
    arr = train.select(vector_to_array(vec).alias("a"))
    first = arr.first()
    if first is None:
        return []
    grid = F.lit([i / bins for i in range(bins + 1)])
    row = arr.agg(*[F.percentile_approx(F.col("a")[j], grid, 20_000).alias(f"q{j}") for j in range(len(first["a"]))]).first()
    return [np.unique(np.array(q, dtype=np.float64))[:-1] for q in row]


def midpoints(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Cuts of MLlib's trees: midway between neighbouring distinct values, at
    most ``most``, about as much weight between any two."""
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2
    stride = weights.sum() / (most + 1)
    run, target, out = np.cumsum(weights), stride, []
    for i in range(1, len(values)):
        if abs(run[i - 1] - target) < abs(run[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out)


def midpoint_cuts(train: DataFrame, weight: Column, vec: str = "features", bins: int = 32) -> list[np.ndarray]:
    """Cuts as MLlib finds them, of all rows: from the weights of all values up
    to ``TASK_ROWS`` rows, beyond from quantiles."""
    if train.count() > TASK_ROWS:
        return feature_cuts(train, vec, bins)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, w = pc.list_flatten(b.column("a")).to_numpy().reshape(b.num_rows, -1), b.column("w").to_numpy()
            for j, column in enumerate(x.T):
                values, at = np.unique(column, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), j, np.int32)), pa.array(values), pa.array(np.bincount(at, w))], names=["j", "v", "w"])

    def cut(key: tuple, part):
        import pandas as pd

        values, at = np.unique(part["v"].to_numpy(), return_inverse=True)
        return pd.DataFrame({"j": [key[0]], "cuts": [midpoints(values, np.bincount(at, part["w"].to_numpy()), bins - 1)]})

    rows = train.select(vector_to_array(vec).alias("a"), weight.cast("double").alias("w"))
    found = rows.mapInArrow(counted, "j int, v double, w double").groupBy("j").applyInPandas(cut, "j int, cuts array<double>")
    return [np.array(r["cuts"], dtype=np.float64) for r in sorted(found.collect(), key=lambda r: r["j"])]


class Bins:
    """Where each feature's bins lie in one long histogram."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.sizes = np.array([len(c) + 1 for c in cuts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.total = int(self.sizes.sum())
        #: per place: its feature, where that feature starts, its bin
        self.feature = np.repeat(np.arange(len(cuts)), self.sizes)
        self.first = np.repeat(self.starts, self.sizes)
        self.bin = np.arange(self.total) - self.first
        #: places after which a feature can be cut
        self.open = self.bin < np.repeat(self.sizes - 1, self.sizes)
        #: features of at most two bins, summed up eight at a time, and the others
        self.narrow, self.wide = np.flatnonzero(self.sizes <= 2), np.flatnonzero(self.sizes > 2)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)


#: the eight features of a byte in each of its values
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def packed_columns(x: np.ndarray, bins: Bins) -> tuple[np.ndarray, int]:
    """Binned rows as columns, and how many of them are bytes of eight narrow
    features; these come first, then the wide ones. Few rows are not packed."""
    if len(x) < PACK_ROWS or not len(bins.narrow):
        return np.ascontiguousarray(x.T), 0
    packed = np.packbits(x[:, bins.narrow], axis=1)
    return np.ascontiguousarray(np.concatenate([packed, x[:, bins.wide]], axis=1).T), packed.shape[1]


def histograms(columns: np.ndarray, packed: int, slot: np.ndarray, values: tuple[np.ndarray | None, ...], slots: int, bins: Bins) -> np.ndarray:
    """(slot, place, value): sums of the values, or counts for None, by bin of
    the rows of ``columns``, the first ``packed`` of them bytes."""
    out = np.empty((slots, bins.total, len(values)))
    first = slot * 256  # a bin is below 256
    wide = bins.wide if packed else np.arange(len(bins.sizes))
    for i, column in enumerate(columns):
        place = first + column
        for j, v in enumerate(values):
            cells = np.bincount(place, v, slots * 256).reshape(-1, 256)
            if i >= packed:
                f = wide[i - packed]
                out[:, bins.starts[f] : bins.starts[f] + bins.sizes[f], j] = cells[:, : bins.sizes[f]]
                continue
            features = bins.narrow[8 * i : 8 * i + 8]
            n, two = len(features), bins.sizes[features] == 2
            out[:, bins.starts[features], j] = (cells @ (1.0 - BITS))[:, :n]
            out[:, bins.starts[features][two] + 1, j] = (cells @ BITS)[:, :n][:, two]
    return out


@dataclass
class Block:
    """Binned rows with label, weight, key hash and the margin so far."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    margin: np.ndarray


def training_blocks(train: DataFrame, bins: Bins, weight: Column, vec: str = "features", label: str = "label", key: str = "k") -> RDD:
    """The training rows as an RDD of cached ``Block``s, a single one up to
    ``TASK_ROWS`` rows. Of more, input partitions are merged, without a shuffle,
    until a task has about a full block, or all cores have a task; a step of a fit
    has one task per partition, whose start would cost more than few rows, and
    which sums its blocks one after the other."""
    names = ["bins", "y", "w", "key"]
    count = train.count()
    tasks = 1 if count <= TASK_ROWS else min(-(-count // BLOCK_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    full = BLOCK_ROWS if tasks > 1 else count + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = pc.list_flatten(t.column("a")).to_numpy().reshape(t.num_rows, -1)
            cells = [bins.of(x).tobytes(), *[t.column(c).to_numpy().tobytes() for c in names[1:]]]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=names)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= full:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    rows = train.select(
        vector_to_array(vec).alias("a"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"), F.xxhash64(key).alias("key")
    )
    packed = rows.coalesce(max(1, tasks)).mapInArrow(run, "bins binary, y binary, w binary, key binary")
    width = len(bins.cuts)

    def unpack(r) -> Block:
        y = np.frombuffer(r["y"])
        return Block(np.frombuffer(r["bins"], np.uint8).reshape(-1, width), y, np.frombuffer(r["w"]), np.frombuffer(r["key"], np.int64).view(np.uint64), np.zeros(len(y)))

    return packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def summed(blocks: RDD, histogram: Callable[[Block], np.ndarray], slices: int = 1) -> np.ndarray | None:
    """The sum of one array per block. Partial sums of the tasks are added on
    the executors, in ``slices`` of the first axis and in the order of the
    tasks, so that the driver gets one array however many blocks there are."""

    def part(i: int, it: Iterable[Block]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        total = None
        for b in it:
            h = histogram(b)
            total = h if total is None else total + h
        if total is not None:
            yield from ((s, (i, piece)) for s, piece in enumerate(np.array_split(total, slices)))

    def joined(it: Iterable[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, np.ndarray]]:
        parts: dict[int, list] = {}
        for s, piece in it:
            parts.setdefault(s, []).append(piece)
        for s, pieces in parts.items():
            yield s, reduce(np.add, [p for _, p in sorted(pieces, key=lambda p: p[0])])

    arrays = blocks.mapPartitionsWithIndex(part)
    if blocks.getNumPartitions() > 1:
        arrays = arrays.partitionBy(slices, int).mapPartitions(joined)
    else:
        arrays = arrays.mapPartitions(joined)
    got = sorted(arrays.collect(), key=lambda p: p[0])
    return np.concatenate([p for _, p in got]) if got else None


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each key, fixed by key and salt (splitmix64)."""
    x = key ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# ---------------------------------------------------------------- scoring
def score_rows(df: DataFrame, raw: Callable[[np.ndarray], np.ndarray], vec: str = "features", out: str = "score") -> DataFrame:
    """``df`` with a column of ``raw`` over its feature vectors, an Arrow batch
    at a time."""

    @F.pandas_udf("double")
    def scored(a):
        import pandas as pd

        return pd.Series(raw(np.stack(a.to_numpy())) if len(a) else np.zeros(0))

    return df.withColumn(out, scored(vector_to_array(vec)))
