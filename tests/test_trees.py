"""Histogram boosting, randomised trees and attributions against brute force."""

from __future__ import annotations

import dataclasses
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retainlab.operators import attribution as A
from retainlab.operators import boosting as B
from retainlab.operators import hist_trees as H
from retainlab.operators import random_trees as R


def table(n: int = 160, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n) / 4, rng.integers(0, 2, n), rng.normal(size=n).round(1), np.ones(n), rng.integers(0, 4, n)], axis=1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3) > 1).astype(float)
    w = rng.choice([1.0, 2.5], n)
    return x, y, w


def frame(spark, x, y, w):
    rows = [(i, Vectors.dense(a.tolist()), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["k", "features", "label", "weight"])


class Plain:
    """Best-first tree by full search over all values, one split at a time."""

    def __init__(self, x, g, h, s):
        self.x, self.g, self.h, self.s = x, g, h, s

    def worth(self, m):
        t = np.sign(self.g[m].sum()) * max(abs(self.g[m].sum()) - self.s.l1, 0)
        return t * t / (self.h[m].sum() + self.s.l2 + 1e-12)

    def best(self, m):
        out = (0.0, None)
        for f in range(self.x.shape[1]):
            for t in np.unique(self.x[m, f])[:-1]:
                a, b = m & (self.x[:, f] <= t), m & (self.x[:, f] > t)
                if min(a.sum(), b.sum()) < self.s.min_rows or min(self.h[a].sum(), self.h[b].sum()) < self.s.min_hessian:
                    continue
                gain = self.worth(a) + self.worth(b) - self.worth(m)
                if gain > out[0] + 1e-9:
                    out = (gain, (f, a, b))
        return out

    def grow(self):
        leaves = [np.ones(len(self.x), bool)]
        depth = [0]
        while not self.s.max_leaves or len(leaves) < self.s.max_leaves:
            found = [self.best(m) if not self.s.max_depth or d < self.s.max_depth else (0.0, None) for m, d in zip(leaves, depth)]
            i = max(range(len(leaves)), key=lambda j: found[j][0])
            if found[i][1] is None:
                break
            _, (_, a, b) = found[i]
            d = depth[i] + 1
            leaves[i : i + 1], depth[i : i + 1] = [a, b], [d, d]
        out = np.zeros(len(self.x))
        for m in leaves:
            t = np.sign(self.g[m].sum()) * max(abs(self.g[m].sum()) - self.s.l1, 0)
            out[m] = -self.s.rate * t / (self.h[m].sum() + self.s.l2 + 1e-12)
        return out, leaves


@pytest.mark.parametrize("s", [
    B.Settings(rounds=3, rate=0.3, max_leaves=6, min_rows=8, l1=0.1, l2=0.1),
    B.Settings(rounds=3, rate=0.3, max_depth=3, min_hessian=1.0, l2=1.0),
    B.Settings(rounds=2, rate=0.5, max_leaves=12, max_depth=4, min_rows=3, l1=1.0),
])
def test_boosted_trees_equal_full_search(spark, s):
    x, y, w = table()
    model = B.fit_boosted(frame(spark, x, y, w), s, F.col("weight"))
    margin = np.full(len(x), math.log((w * y).sum() / (w * (1 - y)).sum()))
    assert abs(model.start - margin[0]) < 1e-12
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        step, leaves = Plain(x, w * (p - y), w * p * (1 - p), s).grow()
        got = tree.predict(x)
        assert np.allclose(got, step, atol=1e-9)
        assert sorted(tree.cover[tree.left == np.arange(len(tree.left))].tolist()) == sorted(float(m.sum()) for m in leaves)
        margin = margin + got
    assert np.allclose(model.margin(x), margin)


def test_first_order_splits_by_rows_and_steps_by_hessian(spark):
    x, y, w = table()
    s = B.Settings(rounds=2, rate=0.3, max_depth=2, min_rows=10, first_order=True)
    model = B.fit_boosted(frame(spark, x, y, np.ones(len(x))), s, F.lit(1.0))
    margin = np.full(len(x), model.start)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        _, leaves = Plain(x, p - y, np.ones(len(x)), s).grow()
        step = np.zeros(len(x))
        for m in leaves:
            step[m] = -0.3 * (p - y)[m].sum() / ((p * (1 - p))[m].sum() + 1e-12)
        assert np.allclose(tree.predict(x), step, atol=1e-9)
        margin = margin + tree.predict(x)


def test_adaboost_equals_its_definition(spark, monkeypatch):
    x, y, w = table()
    balanced = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    model = B.fit_adaboost(frame(spark, x, y, balanced), F.col("weight"), rounds=25, rate=0.5, max_depth=2)
    weight = np.ones(len(x)) / len(x)  # uniform at the start; class weights only inside the tree
    for tree, say in zip(model.trees, model.says):
        _, leaves = Plain(x, weight * balanced * y, weight * balanced, B.Settings(rounds=1, rate=1, max_depth=2)).grow()
        share = np.zeros(len(x))
        for m in leaves:
            share[m] = (weight * balanced * y)[m].sum() / (weight * balanced)[m].sum()
        assert np.allclose(tree.predict(x), share, atol=1e-9)
        missed = (share > 0.5) != (y > 0.5)
        error = weight[missed].sum() / weight.sum()
        assert abs(say - 0.5 * math.log((1 - error) / error)) < 1e-9
        weight = weight * np.exp(say * missed)
        weight = weight / weight.sum()
    assert len(model.trees) == 25
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    many = B.fit_adaboost(frame(spark, x, y, balanced).repartition(4), F.col("weight"), rounds=25, rate=0.5, max_depth=2)
    assert np.allclose(many.says, model.says)


def test_rows_on_several_blocks_give_the_same_trees(spark, monkeypatch):
    x, y, w = table(300)
    s = B.Settings(rounds=20, rate=0.2, max_leaves=7, min_rows=5, l2=0.1, rows=0.7, columns=0.6)
    df = frame(spark, x, y, w).repartition(5)
    one = B.fit_boosted(df, s, F.col("weight"))
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "CHECKPOINTS", 1)
    many = B.fit_boosted(df, s, F.col("weight"))
    assert len(one.trees) == len(many.trees) == 20
    assert np.allclose(one.margin(x), many.margin(x), atol=1e-9)
    covers = [t.cover[0] for t in one.trees]
    assert len(set(covers)) > 5 and abs(np.mean(covers) / 300 - 0.7) < 0.05
    used = [set(t.feature[t.left != np.arange(len(t.left))].tolist()) for t in one.trees]
    assert all(len(u) <= 3 for u in used) and len(set().union(*used)) > 3


def test_rows_in_several_tasks_give_the_same_trees(spark, monkeypatch):
    x, y, w = table(300)
    s = B.Settings(rounds=12, rate=0.2, max_leaves=7, min_rows=5, l2=0.1, rows=0.7, columns=0.6)
    df = frame(spark, x, y, w).repartition(5)
    one, ada = B.fit_boosted(df, s, F.col("weight")), B.fit_adaboost(df, F.col("weight"), rounds=8, max_depth=2)
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    monkeypatch.setattr(H, "TASK_ROWS", 64)
    monkeypatch.setattr(B, "CHECKPOINTS", 1)
    made, plain = [], B.Spread.__init__
    monkeypatch.setattr(B.Spread, "__init__", lambda self, *a: (made.append(1), plain(self, *a))[1])
    many, spread = B.fit_boosted(df, s, F.col("weight")), B.fit_adaboost(df, F.col("weight"), rounds=8, max_depth=2)
    assert len(made) == 2 and len(one.trees) == len(many.trees) == 12
    assert np.allclose(one.margin(x), many.margin(x), atol=1e-9)
    assert np.allclose(ada.says, spread.says) and np.allclose(ada.score(x), spread.score(x))


def test_more_rows_than_a_block_stay_in_one_task(spark, monkeypatch):
    x, y, w = table(300)
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    df = frame(spark, x, y, w).repartition(5)
    bins = H.Bins(H.feature_cuts(df))
    blocks = H.training_blocks(df, bins, F.col("weight"))
    assert blocks.getNumPartitions() == 1 and [len(b.y) for b in blocks.collect()] == [300]
    blocks.unpersist()


def test_a_block_in_pieces_gives_the_same_trees(monkeypatch):
    x, y, w = table(300)
    bins = H.Bins([np.unique(c)[:-1] for c in x.T])
    s = B.Settings(rounds=6, rate=0.3, max_leaves=9, min_rows=2, rows=0.8, bootstrap=True)

    def margin():
        data = B.Together(H.Block(bins.of(x), y, w, np.arange(300, dtype=np.uint64), np.zeros(300)), 0.1, B.logistic)
        for i in range(s.rounds):
            data.add(B.Added(B.grow(data, bins, s, i)))
        return np.concatenate([p.block.margin for p in data.pieces])

    one = margin()
    monkeypatch.setattr(H, "PACK_ROWS", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    assert np.allclose(margin(), one, atol=1e-9)


@pytest.mark.parametrize("least", [0, 1000])
def test_histograms_of_packed_features(monkeypatch, least):
    monkeypatch.setattr(H, "PACK_ROWS", least)
    rng = np.random.default_rng(5)
    sizes = [2, 1, 5, 2, 2, 256, 2, 2, 2, 1, 2, 2, 2, 3]  # more than eight narrow features, some with one value
    bins = H.Bins([np.arange(n - 1, dtype=float) for n in sizes])
    x = np.stack([rng.integers(0, n, 500) for n in sizes], axis=1).astype(np.uint8)
    slot, g = rng.integers(0, 3, 500), rng.normal(size=500)
    got = H.histograms(*H.packed_columns(x, bins), slot, (g, None), 3, bins)
    for i in range(3):
        for f, n in enumerate(sizes):
            for b in range(n):
                rows = (slot == i) & (x[:, f] == b)
                assert np.allclose(got[i, bins.starts[f] + b], [g[rows].sum(), rows.sum()], atol=1e-9)


def test_residual_trees_are_those_of_mllib(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from retainlab.operators import models as MD

    x, y, w = table(400)
    rng = np.random.default_rng(8)
    x = np.concatenate([x, rng.normal(size=(400, 2))], axis=1)  # more values than bins
    df = frame(spark, x, y, w).repartition(3).cache()
    presets = {"boosting_depth5": {"maxIter": 25, "stepSize": 0.2, "maxDepth": 5}}
    est = MD.make_estimator("boosting_depth5", 400, presets=presets)
    want = {r["k"]: r["score"] for r in MD.prob1(est.fit(df).transform(df)).collect()}
    monkeypatch.setattr(GBTClassifier, "fit", lambda *_: pytest.fail("a job a level"))
    got = {r["k"]: r["score"] for r in MD.fit_score("boosting_depth5", df, df, 400, x.shape[1], presets).collect()}
    assert np.allclose([got[i] for i in range(400)], [want[i] for i in range(400)], atol=1e-6)
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    monkeypatch.setattr(H, "TASK_ROWS", 64)  # several tasks, cuts from quantiles
    many = B.fit_residual_trees(df, 25, 0.2, 5, F.col("weight")).score(x)
    assert ((many > 0.5) == (y > 0.5)).mean() > 0.95
    assert B.fit_residual_trees(df.limit(0), 2, 0.2, 5, F.col("weight")).trees == []


def test_one_class_and_no_rows(spark):
    x, y, w = table(20)
    s = B.Settings(rounds=2, rate=0.1, max_depth=2)
    assert (B.fit_boosted(frame(spark, x, np.ones(20), w), s, F.col("weight")).score(x) > 0.99).all()
    assert B.fit_boosted(frame(spark, x, y, w).limit(0), s, F.col("weight")).trees == []
    assert R.fit_extra_trees(frame(spark, x, y, w).limit(0), F.col("weight"), trees=2).trees == []


def test_cuts_are_all_values_of_a_feature_with_few(spark):
    x, y, w = table()
    cuts = H.feature_cuts(frame(spark, x, y, w))
    assert all(c.tolist() == np.unique(x[:, j])[:-1].tolist() for j, c in enumerate(cuts))


def test_random_thresholds_lie_inside_the_node(spark):
    x, y, w = table()
    forest = R.fit_extra_trees(frame(spark, x, y, w), F.col("weight"), trees=12)
    order = np.arange(len(x))
    first = set()
    for t in forest.trees:
        at = {0: order}
        for node in range(len(t.left)):
            rows = at[node]
            assert t.cover[node] == len(rows)
            if t.left[node] == node:
                share = (w[rows] * y[rows]).sum() / w[rows].sum()
                assert abs(t.value[node] - share) < 1e-9
                alike = (x[rows] == x[rows[0]]).all()
                assert alike or share in (0.0, 1.0)
                continue
            v = x[rows, t.feature[node]]
            assert v.min() <= t.threshold[node] < v.max()
            at[int(t.left[node])], at[int(t.right[node])] = rows[v <= t.threshold[node]], rows[v > t.threshold[node]]
        first.add((int(t.feature[0]), float(t.threshold[0])))
    assert len(first) == 12  # differs by tree
    again = R.fit_extra_trees(frame(spark, x, y, w).repartition(7), F.col("weight"), trees=12)
    assert (again.score(x) == forest.score(x)).all()


def test_random_trees_see_all_rows(spark):
    from pyspark.ml.functions import array_to_vector

    n = 20_500
    df = spark.range(n).select(
        F.col("id").alias("k"), array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double"))).alias("features"),
        (F.col("id") % 3 == 0).cast("double").alias("label"), F.lit(1.0).alias("weight"),
    )
    forest = R.fit_extra_trees(df, F.col("weight"), trees=2, max_depth=1)
    assert [t.cover[0] for t in forest.trees] == [n, n]


def test_random_trees_stay_in_the_tasks(spark, monkeypatch):
    from pyspark import RDD

    x, y, w = table(300)
    df = frame(spark, x, y, w).repartition(5)
    forest = R.fit_extra_trees(df, F.col("weight"), trees=11)
    twice = df.withColumn("k", F.when(F.col("k") < 100, F.col("k") % 50).when(F.col("k") < 290, F.col("k")))  # equal and null keys
    with monkeypatch.context() as m:
        m.setattr(RDD, "collect", lambda _: pytest.fail("trees on the driver"))
        scored = R.score_forest(twice, forest)
    got = scored.collect()
    assert scored.columns == [*df.columns, "score"] and len(got) == 300
    want = forest.score(np.stack([r["features"].toArray() for r in got]))
    assert np.allclose([r["score"] for r in got], want, atol=1e-12)
    none = R.score_forest(df, R.fit_extra_trees(df.limit(0), F.col("weight"), trees=3)).collect()
    assert len(none) == 300 and {r["score"] for r in none} == {0.0}
    assert R.score_forest(df.limit(0), forest).count() == 0


def test_random_trees_a_few_rows_at_a_time(monkeypatch):
    x, y, w = table(300)
    whole = [R.grow(x, y, w, 2, [1, i]) for i in range(3)]
    monkeypatch.setattr(R, "STEP_ROWS", 16)
    for a, b in zip(whole, (R.grow(x, y, w, 2, [1, i]) for i in range(3))):
        assert (a.left == b.left).all() and (a.threshold == b.threshold).all() and np.allclose(a.value, b.value, atol=1e-12)


def test_random_split_is_the_best_of_its_draws():
    x, y, w = table()
    rng = np.random.default_rng(3)
    starts = np.array([0, 50, 120])
    level = R.look(x, y, w, starts, rng)
    drop = R.impurity_drop(level)

    def gini(m):
        return w[m].sum() * (1 - sum(((w[m] * (y[m] == c)).sum() / w[m].sum()) ** 2 for c in (0, 1))) if len(m) else 0.0

    for i, (a, b) in enumerate(zip(starts, [50, 120, 160])):
        rows = np.arange(a, b)
        for f in range(x.shape[1]):
            left = rows[x[rows, f] <= level.threshold[i, f]]
            assert abs(drop[i, f] - (gini(rows) - gini(left) - gini(np.setdiff1d(rows, left)))) < 1e-9
    all_features = R.choose(level, x.shape[1], rng)
    varies = level.high > level.low
    assert (all_features == np.where(varies, drop, -np.inf).argmax(axis=1)).all()
    assert all(varies[i, f] for i, f in enumerate(R.choose(level, 1, rng)))


def by_subsets(tree: H.Tree, row: np.ndarray) -> np.ndarray:
    """Shapley values straight from their definition, over all feature subsets."""

    def value(known, node=0):
        if tree.left[node] == node:
            return tree.value[node]
        a, b = int(tree.left[node]), int(tree.right[node])
        f = int(tree.feature[node])
        if f in known:
            return value(known, a if row[f] <= tree.threshold[node] else b)
        return (tree.cover[a] * value(known, a) + tree.cover[b] * value(known, b)) / tree.cover[node]

    m, out = len(row), np.zeros(len(row))
    for j in range(m):
        others = [k for k in range(m) if k != j]
        for n in range(m):
            for s in itertools.combinations(others, n):
                weight = math.factorial(n) * math.factorial(m - n - 1) / math.factorial(m)
                out[j] += weight * (value({*s, j}) - value(set(s)))
    return out


def test_attributions_equal_all_subsets_and_sum_to_the_score(spark):
    x, y, w = table()
    df = frame(spark, x, y, w)
    boosted = B.fit_boosted(df, B.Settings(rounds=4, rate=0.4, max_depth=3), F.col("weight"))
    forest = R.fit_extra_trees(df, F.col("weight"), trees=3, max_depth=3)
    for trees, base, rate, total in ((boosted.trees, boosted.start, 1.0, boosted.margin(x)), (forest.trees, 0.0, 1 / 3, forest.score(x))):
        got = {r["k"]: r for r in A.attributions(df, trees, "k", base, rate=rate).collect()}
        phi = np.array([got[i]["contributions"] for i in range(len(x))])
        assert np.allclose(phi.sum(axis=1) + got[0]["base"], total, atol=1e-9)
        for i in (0, 7, 33):
            assert np.allclose(phi[i], rate * sum(by_subsets(t, x[i]) for t in trees), atol=1e-9)


def test_top_contributions(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0, 0.0, 2.0])], "k long, contributions array<double>")
    got = A.top_contributions(df, "k", ["a", "b", "c", "d"], 3).collect()
    assert [(r["rank"], r["feature"], r["direction"]) for r in got] == [(1, "b", "decreases churn"), (2, "d", "increases churn"), (3, "a", "increases churn")]


def test_the_driver_gets_one_array_of_many_blocks(spark, monkeypatch):
    from pyspark import RDD

    arrays, plain = [], RDD.collect

    def counted(self):
        got = plain(self)
        arrays.append(len(got))
        return got

    parts = spark.sparkContext.parallelize(range(12), 6)
    monkeypatch.setattr(RDD, "collect", counted)
    for slices, most in ((1, 1), (3, 3)):
        total = H.summed(parts, lambda i: np.full((5, 2), float(i)), slices)
        assert (total == np.full((5, 2), 66.0)).all()
        assert arrays.pop() <= most
    assert H.summed(spark.sparkContext.parallelize([], 3), lambda i: np.zeros(1)) is None
