"""Trained models: one score in [0, 1] per row, better than chance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retainlab.plans.registry import all_queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["fit_random_forest", "fit_leafwise", "fit_second_order", "fit_extra_trees", "fit_adaboost", "fit_svm_rff"])
def test_fit(spark, name):
    got = all_queries()[name](spark, SF).cache()
    n = got.count()
    assert n and got.filter(F.col("score").between(0, 1)).count() == n
    assert got.groupBy(got.columns[0]).count().filter("count > 1").count() == 0
    from retainlab.operators import evaluate as E

    assert E.roc_auc(got.withColumn("model", F.lit("m"))).first()["roc_auc"] > 0.8
    got.unpersist()


def test_fits_use_the_modelled_settings(spark):
    from retainlab.operators import models as MD

    for name, preset in MD.REFERENCE_PRESETS.items():
        if name not in ("logistic_regression", "adaboost", "mlp", "knn"):
            est = MD.make_estimator(name, 100)
            assert {k: est.getOrDefault(k) for k in preset} == preset


def test_adaboost_scores_over_many_trees(spark):
    from pyspark.ml.linalg import Vectors

    from retainlab.operators import models as MD

    rows = [(i, Vectors.dense([i % 7, i % 5]), float((i * i + i % 3) % 2), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, ["k", "features", "label", "weight"]).repartition(1).cache()
    got = MD.adaboost(df, df, rounds=22, max_depth=1)
    assert got.columns == [*df.columns, "score"] and got.filter(F.col("score").between(0, 1)).count() == 60


def test_fits_run_in_as_many_tasks_as_rows_need(spark, monkeypatch, tmp_path):
    from retainlab.operators import models as MD
    from retainlab.plans import q_models as QM

    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1000, numPartitions=10 * cores)
    assert MD.few_tasks(df, 1000).rdd.getNumPartitions() == 2 * cores
    assert MD.few_tasks(df, 1000).count() == 1000
    few = spark.range(1000, numPartitions=2 * cores)
    assert MD.few_tasks(few, 1000) is few
    monkeypatch.setattr(MD, "TASK_ROWS", 10)
    assert MD.few_tasks(df, 30 * cores).rdd.getNumPartitions() == 3 * cores
    monkeypatch.undo()

    prepared = spark.range(600).select(
        F.col("id").alias("k"), F.col("id").cast("string").alias("customerID"), F.when(F.col("id") % 7 < 5, "train").otherwise("test").alias("split"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"), (F.col("id") % 11).cast("double").alias("x"),
    ).repartition(10 * cores, "k")
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(prepared)
    monkeypatch.setattr(QM, "prepared_vectors", lambda *_: (vectors, type("Prepared", (), {"names": ["x"]})))
    v, train, n, _ = QM._data(spark, str(tmp_path))
    assert v.rdd.getNumPartitions() > 2 * cores >= train.rdd.getNumPartitions()
    assert train.count() == n == vectors.filter("split = 'train'").count()
    v.unpersist()
    train.unpersist()


def test_large_forests_are_fitted_some_trees_at_a_time(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    from retainlab.operators import models as MD

    rows = [(i % 50, Vectors.dense([i % 7, i % 5, i % 3]), float((i * i + i % 3) % 2), 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, ["k", "features", "label", "weight"]).repartition(2).cache()  # equal keys
    presets = {"forest_nobootstrap": {"numTrees": 7, "maxDepth": 30}}
    fitted, plain = [], RandomForestClassifier.fit

    def fit(self, data):
        model = plain(self, data)
        fitted.append((self.getNumTrees(), self.getSeed(), MD.prob1(model.transform(df)).select("k", "features", "score").collect()))
        return model

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    monkeypatch.setattr(MD, "FOREST_NODES", 3 * 180)
    got = MD.fit_score("forest_nobootstrap", df, df, 90, 3, presets)
    assert got.columns == [*df.columns, "score"]
    assert [f[:2] for f in fitted] == [(3, 42), (3, 43), (1, 44)]
    seen = {(r["k"], r["features"]): r["score"] for r in got.collect()}
    assert got.count() == 90
    votes = {}
    for n, _, scored in fitted:
        for key, score in {(r["k"], r["features"]): r["score"] for r in scored}.items():
            votes[key] = votes.get(key, 0.0) + n * score
    assert seen == pytest.approx({k: v / 7 for k, v in votes.items()}, abs=1e-9)
    fitted.clear()
    monkeypatch.setattr(MD, "FOREST_NODES", 7 * 180)
    MD.fit_score("forest_nobootstrap", df, df, 90, 3, presets)
    assert [f[:2] for f in fitted] == [(7, 42)]
