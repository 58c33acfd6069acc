"""Model versions and results by tier."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from retainlab.operators import boosting as B
from retainlab.sources import store as S


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(a + b > 0.2)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, label double").cache()
    prep = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")]).fit(df)
    model = B.fit_boosted(prep.transform(df), B.Settings(rounds=6, rate=0.3, max_depth=3), F.lit(1.0))
    return df, S.Served(prep, model, {"name": "m", "threshold_f1": 0.37, "threshold_mcc": 0.41, "threshold_biz": 0.1, "features": ["a", "b"]})


def _scores(served, df):
    return [tuple(r) for r in served.score(df).select("k", "score").orderBy("k").collect()]


def test_a_loaded_version_scores_as_it_was_fitted(spark, fitted, tmp_path):
    df, served = fitted
    folder = str(tmp_path / "model")
    assert S.versions(spark, folder) == []
    with pytest.raises(FileNotFoundError):
        S.load_model(spark, folder)
    assert S.save_model(spark, folder, served) == 1
    other = S.Served(served.preprocessor, B.Boosted(1.5, served.model.trees[:2]), {**served.info, "threshold_f1": 0.6})
    assert S.save_model(spark, folder, other) == 2
    assert _scores(S.load_model(spark, folder, 1), df) == _scores(served, df)
    last = S.load_model(spark, folder)
    assert last.info["threshold_f1"] == 0.6 and last.info["features"] == ["a", "b"] and _scores(last, df) == _scores(other, df)


def test_a_version_that_broke_off_is_not_loaded(spark, fitted, tmp_path):
    df, served = fitted
    folder = str(tmp_path / "model")
    S.save_model(spark, folder, served)
    S.write_table(spark.createDataFrame(S.tree_rows(served.model.trees), S.TREES), f"{folder}/v2/trees")
    assert S.versions(spark, folder) == [1]
    assert _scores(S.load_model(spark, folder), df) == _scores(served, df)


def test_writing_a_tier_again_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "portfolio")
    both = spark.createDataFrame([("a", 0.1, "Low"), ("b", 0.9, "High")], "id string, p double, risk_tier string")
    S.write_by_tier(both, path)
    S.write_by_tier(spark.createDataFrame([("c", 0.8, "High")], both.schema), path)
    assert sorted(r["id"] for r in S.read_by_tier(spark, path).collect()) == ["a", "c"]
    assert [r["id"] for r in S.read_by_tier(spark, path, ["Low"]).collect()] == ["a"]


def test_the_served_flag_uses_the_tuned_threshold(spark, fitted):
    from retainlab.plans.q_prepare import prepared_input
    from retainlab.plans.q_serving import served_portfolio

    from .conftest import SMALL

    class Fixed:
        info = {"threshold_f1": 0.3}

        def score(self, profiles):
            return profiles.withColumn("score", F.when(F.col("k") % 2 == 0, 0.35).otherwise(0.25))

    got = served_portfolio(Fixed(), prepared_input(spark, SMALL)).select("k", "predicted_churn").collect()
    assert got and all(r["predicted_churn"] == int(r["k"] % 2 == 0) for r in got)
