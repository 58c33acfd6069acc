"""Tree attributions, path-dependent Shapley values (Lundberg 2018).

For a leaf of value v, each distinct feature j on its path has the share z_j of
covered rows that follow the path at j's nodes, and o_j = 1 if the scored row
follows them, else 0. Not knowing a feature, the row reaches the leaf in
proportion z_j. The value of j is

    v (o_j - z_j) sum_s s! (d-1-s)! / d! e_s,

e_s the coefficient of t^s in the product of (z_k + o_k t) over the other d - 1
features. A leaf's values depend on a row only by its d bits o, so they are
computed once per bit pattern, all of a short path's or those that occur in a
batch, and gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.operators.hist_trees import Tree


@dataclass
class Path:
    """One leaf: its value and, per distinct feature, the open interval of
    values that follow the path and the covered share."""

    value: float
    features: np.ndarray
    above: np.ndarray  # x > above
    upto: np.ndarray  # x <= upto
    share: np.ndarray


def paths(tree: Tree) -> list[Path]:
    out = []
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while todo:
        node, seen = todo.pop()
        if tree.left[node] == node:
            f = np.array(list(seen), dtype=np.int64)
            low, high, share = (np.array([seen[j][i] for j in f]) for i in range(3))
            out.append(Path(float(tree.value[node]), f, low, high, share))
            continue
        f, t = int(tree.feature[node]), float(tree.threshold[node])
        low, high, share = seen.get(f, (-np.inf, np.inf, 1.0))
        whole = tree.cover[node] or 1.0
        for child, bounds in ((tree.left[node], (low, min(high, t))), (tree.right[node], (max(low, t), high))):
            todo.append((int(child), {**seen, f: (*bounds, share * tree.cover[child] / whole)}))
    return out


def pattern_values(path: Path, ones: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf for each row of bits ``ones`` (pattern x d)."""
    d = len(path.features)
    weight = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    out = np.empty(ones.shape)
    for j in range(d):
        e = np.zeros((len(ones), d))
        e[:, 0] = 1.0
        for n, k in enumerate([k for k in range(d) if k != j]):
            grown = e * path.share[k]
            grown[:, 1 : n + 2] += e[:, : n + 1] * ones[:, k, None]
            e = grown
        out[:, j] = path.value * (ones[:, j] - path.share[j]) * (e @ weight)
    return out


def expected(tree: Tree) -> float:
    """Mean leaf value over the covered rows."""
    leaf = tree.left == np.arange(len(tree.left))
    whole = tree.cover[leaf].sum()
    return float((tree.value[leaf] * tree.cover[leaf]).sum() / whole) if whole else float(tree.value[0])


#: Features of a path up to which the values of all bit patterns are kept.
TABLE_BITS = 8


def tabled(path: Path) -> np.ndarray:
    """(feature, code): the values of all bit patterns; the code has bit j for feature j."""
    d = len(path.features)
    ones = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    return np.ascontiguousarray(pattern_values(path, ones.astype(np.float64)).T)


def shapley(all_paths: Sequence[Path], x: np.ndarray, tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """(row, feature): summed values of all leaves. ``tables`` keeps the values
    of patterns by path from one call to the next."""
    tables = {} if tables is None else tables
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    for i, p in enumerate(all_paths):
        d = len(p.features)
        if not d:
            continue
        if d > TABLE_BITS:
            v = columns[p.features].T
            ones = (v > p.above) & (v <= p.upto)
            patterns, at = np.unique(ones, axis=0, return_inverse=True)
            phi[p.features] += pattern_values(p, patterns.astype(np.float64))[at.ravel()].T
            continue
        if i not in tables:
            tables[i] = tabled(p)
        code = np.zeros(len(x), dtype=np.intp)
        for j, f in enumerate(p.features):
            code += ((columns[f] > p.above[j]) & (columns[f] <= p.upto[j])) * (1 << j)
        for row, f in zip(tables[i], p.features):
            phi[f] += row.take(code)
    return phi.T


def attributions(df: DataFrame, trees: Sequence[Tree], key: str, base: float = 0.0, vec: str = "features", rate: float = 1.0) -> DataFrame:
    """(key, base, contributions): per row the base value, ``base`` plus
    ``rate`` times the trees' mean values, and one contribution per feature;
    their sum is the row's margin (boosting) or score (forest, rate 1 / trees)."""
    leaves = [p for t in trees for p in paths(t)]
    start = base + rate * sum(expected(t) for t in trees)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = pc.list_flatten(b.column("x")).to_numpy().reshape(b.num_rows, -1)
            phi = rate * shapley(leaves, x, tables)
            ends = pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(np.full(len(x), start)), pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], names=[key, "base", "contributions"]
            )

    return df.select(key, vector_to_array(vec).alias("x")).mapInArrow(run, f"`{key}` {kind}, base double, contributions array<double>")


def top_contributions(attributed: DataFrame, key: str, names: Sequence[str], n: int = 8) -> DataFrame:
    """The ``n`` largest contributions of each row by size, ties by name."""
    pairs = F.zip_with(F.array(*map(F.lit, names)), "contributions", lambda f, v: F.struct((-F.abs(v)).alias("size"), f.alias("feature"), v.alias("value")))
    top = attributed.select(key, F.posexplode(F.slice(F.sort_array(pairs), 1, n)).alias("at", "t"))
    return top.select(
        key,
        (F.col("at") + 1).alias("rank"),
        F.col("t.feature").alias("feature"),
        F.round("t.value", 4).alias("contribution"),
        F.when(F.col("t.value") > 0, "increases churn").otherwise("decreases churn").alias("direction"),
    )
