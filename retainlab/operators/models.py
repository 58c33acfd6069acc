"""Trained classifiers M1-M16 on prepared feature vectors.

Every fit is an MLlib estimator (distributed) or a fit of this library's tree
learners (``boosting``, ``random_trees``); stacks are in ``stacking``.
``REFERENCE_PRESETS`` holds the modelled settings, the default of the fits;
callers may give others.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainlab.operators import boosting as BO
from retainlab.operators import calibrate as CA
from retainlab.operators import prepare as PR
from retainlab.operators.hist_trees import score_rows
from retainlab.session import checkpoint_dir

FEATURES, LABEL, WEIGHT = "features", "label", "weight"

#: Rows of a task of an iterative fit, where there are more than two tasks a core.
TASK_ROWS = 32_768

#: Nodes that the trees of a forest may have together, of those held at a time.
FOREST_NODES = 4_000_000

# --- fixed values: modelled settings; depth 30 is the most MLlib takes ------
REFERENCE_PRESETS = {
    "logistic_regression": {"C": 1.0},
    "random_forest": {"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
    "gradient_boosting": {"maxIter": 300, "stepSize": 0.03, "maxDepth": 3, "subsamplingRate": 0.8,
                          "minInstancesPerNode": 10},
    "boosting_depth5": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5},
    "boosting_depth4": {"maxIter": 800, "stepSize": 0.05, "maxDepth": 4},
    "bagging": {"numTrees": 300, "subsamplingRate": 0.8, "maxDepth": 30},
    "forest_nobootstrap": {"numTrees": 800, "maxDepth": 30},
    "adaboost": {"rounds": 300, "learning_rate": 0.5, "maxDepth": 3},
    "mlp": {"layers": (64, 32), "maxIter": 500},
    "knn": {"k": 15},
}


def labelled(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """label (double) and balanced class weight columns."""
    out = df.withColumn(LABEL, F.col("y_true").cast("double"))
    if weights is not None:
        out = PR.with_weights(out, weights, out=WEIGHT)
    return out


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, cached or cheap to read, in about as many tasks as its ``rows``
    need, merged without a shuffle: an iterative fit runs thousands of short jobs
    over it, each of which pays for every partition. Few enough partitions stay
    as they are, since MLlib samples rows by partition."""
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def prob1(df: DataFrame, col: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(col)[1])


def make_estimator(name: str, n_train: int, scale_pos_weight: float = 1.0, seed: int = 42,
                   presets: dict = REFERENCE_PRESETS):
    q = presets[name]
    if name == "logistic_regression":
        # C = 1 on the summed loss == regParam 1/(C n) on MLlib's mean loss
        return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT,
                                  regParam=1.0 / (q["C"] * n_train),
                                  elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-4)
    if name == "random_forest":
        return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxDepth=8,
                                      minInstancesPerNode=5, featureSubsetStrategy="sqrt", subsamplingRate=0.8,
                                      numTrees=q["numTrees"], seed=seed)
    if name == "gradient_boosting":
        return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxDepth=3, subsamplingRate=0.8,
                             minInstancesPerNode=10, maxIter=q["maxIter"], stepSize=q["stepSize"], seed=seed)
    if name == "boosting_depth5":
        return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxDepth=5,
                             maxIter=q["maxIter"], stepSize=q["stepSize"], seed=seed)
    if name == "boosting_depth4":
        return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol="pos_weight", maxDepth=4,
                             maxIter=q["maxIter"], stepSize=q["stepSize"], seed=seed)
    if name == "bagging":
        return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT,
                                      featureSubsetStrategy="all", subsamplingRate=0.8, numTrees=q["numTrees"],
                                      maxDepth=q["maxDepth"], seed=seed)
    if name == "forest_nobootstrap":
        return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, bootstrap=False,
                                      featureSubsetStrategy="sqrt", numTrees=q["numTrees"], maxDepth=q["maxDepth"],
                                      maxBins=16, seed=seed)
    raise ValueError(name)


def fit_score(name: str, train: DataFrame, score_on: DataFrame, n_train: int, n_features: int,
              presets: dict = REFERENCE_PRESETS) -> DataFrame:
    """Fit one estimator and return score_on with a ``score`` column."""
    if name == "mlp":
        est = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL,
                                             layers=[n_features, *presets["mlp"]["layers"], 2],
                                             maxIter=presets["mlp"]["maxIter"], seed=42)
    else:
        est = make_estimator(name, n_train, presets=presets)
    if isinstance(est, GBTClassifier) and est.getSubsamplingRate() == 1.0:
        # nothing is drawn: the same trees without MLlib's jobs for every level of every tree
        boosted = BO.fit_residual_trees(train, est.getMaxIter(), est.getStepSize(), est.getMaxDepth(), F.col(est.getWeightCol()), est.getMaxBins(),
                                        FEATURES, LABEL)
        return score_rows(score_on, boosted.score, FEATURES)
    if isinstance(est, RandomForestClassifier):
        return forest_scores(est, train, score_on, n_train)
    model = est.fit(train)
    return prob1(model.transform(score_on))


def forest_scores(est: RandomForestClassifier, train: DataFrame, score_on: DataFrame, n_train: int) -> DataFrame:
    """``score_on`` with the mean vote of all trees. The driver holds a forest it
    fits: where trees can grow large, some are fitted at a time, under a seed of
    their own, and their votes are written before the next."""
    trees, most = est.getNumTrees(), min(2 * max(n_train, 1), 2 ** (est.getMaxDepth() + 1))
    batch = max(1, FOREST_NODES // most)
    if batch >= trees:
        return prob1(est.fit(train).transform(score_on))
    checkpoint_dir(train.sparkSession)
    voted = score_on.withColumn("_votes", F.lit(0.0))
    for i, first in enumerate(range(0, trees, batch)):
        n = min(batch, trees - first)
        part = est.copy({est.numTrees: n, est.seed: est.getSeed() + i}).fit(train)
        voted = prob1(part.transform(voted)).select(*score_on.columns, (F.col("_votes") + F.col("score") * n).alias("_votes")).checkpoint()
    return voted.select(*score_on.columns, (F.col("_votes") / trees).alias("score"))


# ------------------------------------------------------------ M8 AdaBoost
def adaboost(train: DataFrame, score_on: DataFrame, rounds: int = 300, learning_rate: float = 0.5,
             max_depth: int = 3) -> DataFrame:
    """Binary SAMME: row weights start alike, class weights count inside the
    trees only; ``score_on`` with the logistic of the mean vote."""
    model = BO.fit_adaboost(train, F.col(WEIGHT), rounds, learning_rate, max_depth)
    return score_rows(score_on, model.score, FEATURES)


# -------------------------------------------------------- M9 kernel SVM
def fourier_features(df: DataFrame, n_features: int, n_components: int = 100, gamma: float | None = None,
                     seed: int = 42, out: str = "rff") -> DataFrame:
    """Random Fourier features z = sqrt(2/D) cos(W x + b) (Rahimi and Recht
    2007) approximating an RBF kernel; a pandas UDF multiplies each Arrow
    batch by the fixed D x d matrix."""
    g = gamma if gamma is not None else 1.0 / n_features
    rng = np.random.default_rng(seed)
    wmat = rng.normal(0.0, math.sqrt(2 * g), size=(n_components, n_features))
    bvec = rng.uniform(0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(x: pd.Series) -> pd.Series:
        xm = np.vstack(x.to_numpy())
        z = scale * np.cos(xm @ wmat.T + bvec)
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(rff(vector_to_array(FEATURES))))


def scale_gamma(train: DataFrame) -> float:
    """1 / (features x variance of all feature entries), 1 without variance."""
    v = vector_to_array(FEATURES)
    row = train.select(F.size(v).alias("d"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"),
                       F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    r = row.agg(F.max("d").alias("d"), F.sum("d").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not r["n"]:
        return 1.0
    var = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    return 1.0 / (r["d"] * var) if var > 0 else 1.0


def svm_margins(train: DataFrame, n_features: int, C: float = 1.0, gamma: float | None = None, n_components: int = 256,
                max_iter: int = 100):
    """Fit a linear SVM on Fourier features; returns a function that adds the
    margin as ``score``. C on the summed hinge loss is 1 / (C x weights) on
    MLlib's mean loss."""
    g = gamma if gamma is not None else scale_gamma(train)
    total = train.agg(F.sum(WEIGHT)).first()[0]

    def lift(df: DataFrame) -> DataFrame:
        return fourier_features(df, n_features, n_components, g)

    svc = LinearSVC(featuresCol="rff", labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter, standardization=False,
                    regParam=1.0 / (C * total)).fit(lift(train))
    return lambda df: svc.transform(lift(df)).withColumn("score", vector_to_array("rawPrediction")[1])


def svm_rff(train: DataFrame, calib: DataFrame, score_on: DataFrame, n_features: int) -> DataFrame:
    """SVM margins, Platt-scaled on ``calib`` (C4)."""
    margin = svm_margins(train, n_features)
    a, b = CA.fit_platt(margin(calib))
    return CA.apply_platt(margin(score_on), a, b)


# ------------------------------------------------------------ M16 tuning
def random_search(train: DataFrame, trials: int = 4, folds: int = 3, seed: int = 42, parallelism: int = 2):
    """Randomly sampled logistic-regression settings, k-fold CV on a hash fold
    column, F1 of the positive class. Returns (best params, metrics per trial)."""
    rng = random.Random(seed)
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, standardization=False)
    grid = []
    for _ in range(trials):
        pm = ParamGridBuilder().addGrid(lr.regParam, [10 ** rng.uniform(-4, 0)]).addGrid(
            lr.elasticNetParam, [rng.choice([0.0, 0.5, 1.0])]).addGrid(lr.maxIter, [rng.choice([50, 100])]).build()
        grid.extend(pm)
    ev = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="fMeasureByLabel", metricLabel=1.0)
    data = train.withColumn("_fold", F.pmod(F.xxhash64("k"), F.lit(folds)).cast("int"))
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, foldCol="_fold",
                        parallelism=parallelism, seed=seed)
    model = cv.fit(data)
    rows = []
    for i, (pm, m) in enumerate(zip(grid, model.avgMetrics)):
        rows.append((i, float(pm[lr.regParam]), float(pm[lr.elasticNetParam]), int(pm[lr.maxIter]), float(m)))
    return model, rows
