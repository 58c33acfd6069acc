"""K2: exact k-nearest-neighbour join over a metric partition.

1. Pivots: at most ``pivots`` reference vectors (smallest key hashes). Every
   reference lies in the cell of its nearest pivot. References are
   range-partitioned by (cell, distance to the pivot, id) and cut, while each
   task streams its sorted rows, into groups of at most ``group_rows``: a group
   is a ring of one cell, and a hot cell is many groups.
2. Bounds: for each cell its least and greatest pivot distance and its k least
   ones (at most ``pivots`` x k numbers) go to the driver. By the triangle
   inequality the k-th least of d(q, p) + d(p, r) over them bounds the distance
   of q's k-th neighbour. A first probe, of the query's own cell, tightens it.
3. Second probe: a cell is visited only if both |d(q, p) - [least, greatest]|
   and the hyperplane bound (d(q, p)^2 - d(q, p_own)^2) / (2 d(p, p_own)) leave
   room for a distance within the bound, and of a visited cell only the rings
   that meet [d(q, p) - bound, d(q, p) + bound].
4. A probe shuffles each group once and a query once per group it meets. Rows
   of a group come before its queries in the sorted partition, so a task holds
   one group and streams the queries past it. Few groups are dealt over several
   copies, so that the queries of one group do not share one task.

Exact: a bound only ever skips references strictly farther than the k-th
neighbour (bounds carry a slack above rounding, ties are never skipped), and
the order (distance, id) is total. Distances that are returned sum squared
differences in dimension order in double precision, so they equal a sequential
SQL sum bit for bit; a matrix product with slack only selects which are worth
computing. How much is pruned depends on the data: little when distances hardly
differ (random vectors in many dimensions), most when vectors form clusters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retainlab.session import checkpoint_dir

NEIGHBOURS = "qid long, rid long, dist double"
_NEIGHBOURS = pa.schema([("qid", pa.int64()), ("rid", pa.int64()), ("dist", pa.float64())])
SLACK = 1e-9
#: Queries compared with a group at a time.
SLICE = 256


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, squares summed in dimension order."""
    acc = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        acc += d * d
    return np.sqrt(acc)


def choose_pivots(refs: DataFrame, pivots: int) -> np.ndarray:
    rows = refs.orderBy(F.xxhash64("rid"), "rid").limit(pivots).select("v").collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=np.float64), axis=0) if rows else np.zeros((0, 0))


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(rid, v, cell, pd): nearest pivot and the distance to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                d = distances(_matrix(part.column("v")), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["rid", "v", "cell", "pd"]
                )

    return rows.select("rid", "v").mapInArrow(run, "rid long, v array<double>, cell int, pd double")


def in_groups(celled: DataFrame, group_rows: int) -> DataFrame:
    """Column ``gid``: rings of at most ``group_rows`` rows of one cell, numbered
    by the task that streams them; written, so that the numbers stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gid, cell, held = TaskContext.get().partitionId() << 32, None, 0
        for b in batches:
            cells, out = b.column("cell").to_numpy(), np.empty(b.num_rows, dtype=np.int64)
            for i, c in enumerate(cells.tolist()):
                if c != cell or held == group_rows:
                    gid, cell, held = gid + 1, c, 0
                out[i], held = gid, held + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "gid"])

    keys = ["cell", "pd", "rid"]
    ranged = celled.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ranged.mapInArrow(run, "rid long, v array<double>, cell int, pd double, gid long").checkpoint()


class Bounds:
    """What is known of the cells: pivots, least and greatest pivot distance,
    and the k least pivot distances of each."""

    def __init__(self, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, k: int):
        self.pivots, self.low, self.high, self.near, self.k = pivots, low, high, near, k
        self.between = distances(pivots, pivots)

    def upper(self, d: np.ndarray) -> np.ndarray:
        """A bound on each query's k-th distance, from its pivot distances."""
        reach = (d[:, :, None] + self.near[None, :, :]).reshape(len(d), -1)
        return np.partition(reach, self.k - 1, axis=1)[:, self.k - 1] * (1 + SLACK) if reach.shape[1] >= self.k else np.full(len(d), np.inf)

    def open_cells(self, d: np.ndarray, own: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which cells can hold a reference within ``upper`` of each query."""
        ring = np.maximum(d - self.high, self.low - d)
        mine = d[np.arange(len(d)), own]
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d * d - (mine * mine)[:, None]) / (2 * apart), 0.0)
        slack = SLACK * (d + self.high + 1e-30)
        return (np.maximum(ring, plane) - slack <= upper[:, None]) & np.isfinite(self.high)


def rings_of(index: DataFrame, k: int) -> DataFrame:
    """One row per group: its cell, pivot distance range and k least ones."""
    near = F.slice(F.sort_array(F.collect_list("pd")), 1, k)  # a group is bounded
    return index.groupBy("gid", "cell").agg(F.min("pd").alias("low"), F.max("pd").alias("high"), near.alias("near"))


def cell_bounds(rings: DataFrame, pivots: np.ndarray, k: int) -> tuple[Bounds, int]:
    """Bounds and the number of groups. The k least pivot distances of a cell
    lie in its k innermost rings: at most pivots x k rows to the driver."""
    cell = Window.partitionBy("cell")
    inner = rings.select(
        "cell", "low", "near", F.max("high").over(cell).alias("high"), F.count("*").over(cell).alias("groups"),
        F.row_number().over(cell.orderBy("low", "high", "gid")).alias("nth"),
    ).filter(F.col("nth") <= k)
    least: dict[int, list[float]] = {}
    low, high, groups = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), 0
    for r in inner.collect():
        c = r["cell"]
        least.setdefault(c, []).extend(r["near"])
        low[c], high[c] = min(low[c], r["low"]), r["high"]
        groups += r["groups"] if r["nth"] == 1 else 0
    near = np.full((len(pivots), k), np.inf)
    for c, pds in least.items():
        near[c, : len(pds)] = sorted(pds)[:k]
    return Bounds(pivots, low, high, near, k), groups


def visits(queries: DataFrame, bounds: Bounds, own_cell: bool) -> DataFrame:
    """(qid, v, cell, pd, upper): the cells to probe. ``queries`` has the
    columns qid, v and known, the bound so far (null if none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d = distances(_matrix(part.column("v")), bounds.pivots)
                own = d.argmin(axis=1)
                known = part.column("known").to_numpy(zero_copy_only=False).astype(np.float64)
                upper = np.fmin(bounds.upper(d), known * (1 + SLACK))
                rows, cells = np.arange(len(own)), own
                if not own_cell:
                    open_ = bounds.open_cells(d, own, upper)
                    open_[rows, own] = False
                    rows, cells = np.nonzero(open_)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("qid").take(take), part.column("v").take(take), pa.array(cells.astype(np.int32)), pa.array(d[rows, cells]), pa.array(upper[rows])],
                    names=["qid", "v", "cell", "pd", "upper"],
                )

    return queries.select("qid", "v", "known").mapInArrow(run, "qid long, v array<double>, cell int, pd double, upper double")


def nearest_in_group(qid: np.ndarray, q: np.ndarray, upper: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int, other_ids: bool) -> pa.RecordBatch:
    """The k nearest (distance, id) of a group within ``upper``, per query."""
    r2, q2 = (r * r).sum(axis=1), (q * q).sum(axis=1)
    rough = q2[:, None] + r2[None, :] - 2 * (q @ r.T)
    slack = SLACK * (q2 + (r2.max() if len(r2) else 0.0)) + 1e-300
    if other_ids:
        rough[qid[:, None] == rid[None, :]] = np.inf
    limit = upper * upper + slack
    if len(r) > k:
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
    row, col = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
    acc = np.zeros(len(row))
    for i in range(q.shape[1]):
        d = q[row, i] - r[col, i]
        acc += d * d
    dist = np.sqrt(acc)
    best = np.lexsort((rid[col], dist, row))
    row, col, dist = row[best], col[best], dist[best]
    first = np.searchsorted(row, row)  # where the query's candidates start
    keep = np.arange(len(row)) - first < k
    return pa.RecordBatch.from_arrays([pa.array(qid[row[keep]]), pa.array(rid[col[keep]]), pa.array(dist[keep])], schema=_NEIGHBOURS)


def probe(index: DataFrame, rings: DataFrame, wanted: DataFrame, k: int, copies: int, other_ids: bool) -> DataFrame:
    """The k best of each visited group for each of its queries."""
    slack = SLACK * (F.col("pd") + F.col("high"))
    meets = (F.col("low") - slack <= F.col("pd") + F.col("upper")) & (F.col("high") + slack >= F.col("pd") - F.col("upper"))
    asked = wanted.join(rings, "cell").filter(meets).select(
        "gid", F.pmod(F.xxhash64("qid"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), F.col("qid").alias("id"), "v", "upper"
    )
    held = index.select(
        "gid", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), F.col("rid").alias("id"), "v",
        F.lit(0.0).alias("upper"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, group = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("gid", "copy", "kind")], axis=1)
            ids, v, upper = b.column("id").to_numpy(), _matrix(b.column("v")), b.column("upper").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if at != (key[lo, 0], key[lo, 1]):
                    at, parts, group = (key[lo, 0], key[lo, 1]), [], None
                if key[lo, 2] == 0:
                    parts.append((ids[lo:hi], v[lo:hi]))
                    continue
                if group is None:
                    group = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                for s in range(lo, hi, SLICE):
                    e = min(hi, s + SLICE)
                    yield nearest_in_group(ids[s:e], v[s:e], upper[s:e], *group, k, other_ids)

    both = held.unionByName(asked).repartition("gid", "copy").sortWithinPartitions("gid", "copy", "kind")
    return both.mapInArrow(run, NEIGHBOURS)


def _nth(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def metric_knn(queries: DataFrame, refs: DataFrame, k: int, pivots: int = 64, group_rows: int = 8192, other_ids: bool = False) -> DataFrame:
    """(qid, rid, dist, rank): the k nearest ``refs`` (rid, v) of every query
    (qid, v), ties by rid; ``other_ids`` leaves out rid = qid. A query id given
    twice is one query if its vectors are equal. No references: no rows."""
    spark = refs.sparkSession
    checkpoint_dir(spark)
    points = choose_pivots(refs, pivots)
    if not len(points):
        return spark.createDataFrame([], NEIGHBOURS + ", rank int")
    index = in_groups(in_cells(refs, points), group_rows)
    most = k + 1 if other_ids else k
    rings = rings_of(index, most).checkpoint()
    bounds, groups = cell_bounds(rings, points, most)
    copies = max(1, -(-int(spark.sparkContext.defaultParallelism) // groups))
    asked = queries.select("qid", "v").dropDuplicates(["qid"])
    own = visits(asked.withColumn("known", F.lit(None).cast("double")), bounds, True)
    first = probe(index, rings, own, k, copies, other_ids).checkpoint()
    known = _nth(first, k).filter(F.col("rank") == k).select("qid", F.col("dist").alias("known"))
    more = visits(asked.join(known, "qid", "left"), bounds, False)
    return _nth(first.unionByName(probe(index, rings, more, k, copies, other_ids)), k)
