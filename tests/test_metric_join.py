"""K2: the pruned join equals brute force on several cells, rings and ties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainlab.operators import metric_join as M
from retainlab.operators.neighbours import knn_join


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")


def brute(qi, q, ri, r, k, other):
    q, r = q.astype(np.float32).astype(float), r.astype(np.float32).astype(float)
    d = M.distances(q, r)
    out = []
    for a, i in enumerate(qi):
        near = sorted((d[a, b], j) for b, j in enumerate(ri) if not (other and i == j))[:k]
        out += [(int(i), int(j), n + 1, x) for n, (x, j) in enumerate(near)]
    return sorted(out)


def data(kind: str):
    rng = np.random.default_rng(3)
    if kind == "clusters":  # tight, far apart: most cells are skipped
        centres = rng.normal(size=(12, 5)) * 50
        return centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 5)) * 0.1
    if kind == "grid":  # many equal distances
        return rng.integers(0, 3, (300, 3)).astype(float)
    if kind == "copies":  # one hot cell
        return np.concatenate([np.ones((200, 4)), rng.normal(size=(60, 4))])
    return rng.normal(size=(260, 16))


@pytest.mark.parametrize("kind", ["clusters", "grid", "copies", "random"])
@pytest.mark.parametrize("other", [False, True])
def test_equals_brute_force(spark, kind, other):
    v = data(kind)
    ids = np.arange(len(v))
    qi = ids[::7] if other else ids[::7] + 1000
    got = knn_join(frame(spark, qi, v[::7]), frame(spark, ids, v), 6, pivots=9, group_rows=16, exclude_self=other)
    rows = sorted((r["qid"], r["rid"], r["rank"], r["dist"]) for r in got.collect())
    assert rows == brute(qi, v[::7], ids, v, 6, other)


def test_few_references(spark):
    v = data("random")
    got = knn_join(frame(spark, [1, 2], v[:2]), frame(spark, [5, 6, 7], v[5:8]), 6, exclude_self=False)
    assert sorted((r["qid"], r["rid"], r["rank"], r["dist"]) for r in got.collect()) == brute([1, 2], v[:2], [5, 6, 7], v[5:8], 6, False)
    empty = frame(spark, [], v[:0])
    assert knn_join(frame(spark, [1], v[:1]), empty, 3).count() == 0
    assert knn_join(empty, frame(spark, [1], v[:1]), 3).count() == 0


def test_bounds_skip_cells_of_clustered_data(spark):
    v = data("clusters")
    refs = frame(spark, np.arange(300), v).select(F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("v"))
    points = M.choose_pivots(refs, 12)
    index = M.in_groups(M.in_cells(refs, points), 16)
    assert index.groupBy("gid").count().agg(F.max("count")).first()[0] <= 16
    assert index.groupBy("gid").agg(F.countDistinct("cell").alias("c")).agg(F.max("c")).first()[0] == 1
    rings = M.rings_of(index, 3)
    bounds, groups = M.cell_bounds(rings, points, 3)
    for c, near in enumerate(bounds.near.tolist()):
        pds = sorted(r["pd"] for r in index.filter(F.col("cell") == c).select("pd").collect())
        assert near == [*pds[:3], *[float("inf")] * (3 - len(pds[:3]))]
    assert groups == rings.count() >= len(points) - 1
    asked = refs.select(F.col("rid").alias("qid"), "v", F.lit(None).cast("double").alias("known"))
    seen = M.visits(asked, bounds, False).count() + M.visits(asked, bounds, True).count()
    assert seen < 300 * len(points) / 2


def test_no_cross_join(spark):
    v = data("random")
    plan = knn_join(frame(spark, [1], v[:1]), frame(spark, range(9), v[:9]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
