"""Neighbour operators: K2 exact k-nearest-neighbour join, kNN vote (M11),
local competence (N3), KNORA-E (N4), KNORA-U (N5), META-DES (N6).

K2 is the metric-partition join of ``metric_join``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainlab.operators.metric_join import metric_knn


def knn_join(queries: DataFrame, refs: DataFrame, k: int, qid: str = "vec_id", rid: str = "vec_id",
             vec: str = "embedding", pivots: int = 64, group_rows: int = 8192, exclude_self: bool = False) -> DataFrame:
    """(qid, rid, dist, rank): the k nearest references of every query,
    ties by reference id. ``exclude_self`` drops rid == qid (self-join use)."""
    v = F.col(vec).cast("array<double>").alias("v")
    return metric_knn(queries.select(F.col(qid).cast("long").alias("qid"), v),
                      refs.select(F.col(rid).cast("long").alias("rid"), v),
                      k, pivots, group_rows, other_ids=exclude_self)


# ------------------------------------------------------------------ M11
def knn_vote(nb: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """Distance-weighted vote (w = 1/d); zero distances take all the weight."""
    j = nb.join(labels.select(F.col(key).alias("rid"), F.col("y_true").alias("ny")), "rid")
    zero = F.col("dist") == 0
    g = j.groupBy("qid").agg(
        F.count_if(zero).alias("_z"),
        F.sum(F.when(zero, F.col("ny"))).alias("_zy"),
        F.sum(F.try_divide(F.lit(1.0), F.col("dist"))).alias("_w"),
        F.sum(F.try_divide(F.col("ny").cast("double"), F.col("dist"))).alias("_wy"),
    )
    score = F.when(F.col("_z") > 0, F.col("_zy") / F.col("_z")).otherwise(F.try_divide(F.col("_wy"), F.col("_w")))
    return g.select(F.col("qid").alias(key), score.alias("score"))


# ------------------------------------------------------------- N3 - N5
def local_competence(nb: DataFrame, ref_scores: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """Per (query, model): neighbour hits and the length of the correct
    prefix by neighbour rank (k when all are right)."""
    pred = (F.col("score") >= F.lit(threshold)).cast("int")
    rs = ref_scores.select(F.col("vec_id").alias("rid"), "model", (pred == F.col("y_true")).cast("int").alias("ok"))
    j = nb.select("qid", "rid", "rank").join(rs, "rid")
    g = j.groupBy("qid", "model").agg(
        F.sum("ok").cast("int").alias("hits"),
        F.min(F.when(F.col("ok") == 0, F.col("rank"))).alias("_first_wrong"),
    )
    return g.withColumn("prefix", F.coalesce(F.col("_first_wrong") - 1, F.lit(k)).cast("int")).drop("_first_wrong")


def _ordered_mean(weighted: bool) -> Column:
    # sum in model order so both engines add the same doubles in the same order
    arr = F.sort_array(F.collect_list(F.struct("model", "score", "w")))
    if weighted:
        num = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["w"] * x["score"])
        den = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["w"])
    else:
        num = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["score"])
        den = F.size(arr).cast("double")
    return F.try_divide(num, den)


def knora_e(comp: DataFrame, query_scores: DataFrame) -> DataFrame:
    """Models right on the longest neighbour prefix; none right at rank 1
    gives the whole pool. Score = mean of the selected models' scores."""
    w = Window.partitionBy("qid")  # one group = the pool of one query
    c = comp.withColumn("_max", F.max("prefix").over(w))
    sel = c.filter((F.col("_max") == 0) | (F.col("prefix") == F.col("_max"))).select("qid", "model")
    qs = query_scores.select(F.col("vec_id").alias("qid"), "model", "score", F.lit(1.0).alias("w"))
    j = sel.join(qs, ["qid", "model"])
    return j.groupBy("qid").agg(_ordered_mean(False).alias("score"), F.count(F.lit(1)).alias("n_selected"))


def knora_u(comp: DataFrame, query_scores: DataFrame) -> DataFrame:
    """Vote weighted by neighbour hits; all-zero hits fall back to the mean."""
    qs = query_scores.select(F.col("vec_id").alias("qid"), "model", "score")
    j = comp.select("qid", "model", F.col("hits").cast("double").alias("w")).join(qs, ["qid", "model"])
    g = j.groupBy("qid").agg(
        _ordered_mean(True).alias("_wm"), _ordered_mean(False).alias("_m"), F.sum("w").alias("_sw")
    )
    return g.select("qid", F.when(F.col("_sw") > 0, F.col("_wm")).otherwise(F.col("_m")).alias("score"))


# ---------------------------------------------------------------------- N6
def output_profiles(scores: DataFrame) -> DataFrame:
    """(vec_id, profile): the pool's scores of a row in model order."""
    pool = F.sort_array(F.collect_list(F.struct("model", "score")))  # one row's pool
    return scores.groupBy("vec_id").agg(F.transform(pool, lambda m: m["score"]).alias("profile"))


def meta_features(nb: DataFrame, alike: DataFrame, ref_scores: DataFrame, own_scores: DataFrame) -> DataFrame:
    """(qid, model, score, y_true, x): the five meta features of META-DES in one
    vector: whether the model is right on each neighbour by rank, its probability
    of each neighbour's true class, its share right, whether it is right on each
    row of similar pool outputs (``alike``), and its confidence."""
    right = ((F.col("score") >= 0.5).cast("int") == F.col("y_true")).cast("double")
    known = ref_scores.select(
        F.col("vec_id").alias("rid"), "model", right.alias("ok"),
        F.when(F.col("y_true") == 1, F.col("score")).otherwise(F.lit(1.0) - F.col("score")).alias("pt"))

    def by_rank(pairs: DataFrame, name: str) -> DataFrame:
        near = F.sort_array(F.collect_list(F.struct("rank", "ok", "pt")))  # k rows
        return pairs.select("qid", "rid", "rank").join(known, "rid").groupBy("qid", "model").agg(near.alias(name))

    own = own_scores.select(F.col("vec_id").alias("qid"), "model", "score", "y_true")
    j = by_rank(nb, "_a").join(by_rank(alike, "_b"), ["qid", "model"]).join(own, ["qid", "model"])
    oks = F.transform("_a", lambda n: n["ok"])
    share = F.aggregate(oks, F.lit(0.0), lambda s, x: s + x) / F.size("_a")
    x = F.concat(oks, F.transform("_a", lambda n: n["pt"]), F.array(share), F.transform("_b", lambda n: n["ok"]),
                 F.array(F.abs(F.col("score") * 2 - 1)))
    return j.select("qid", "model", "score", "y_true", x.alias("x"))


def disagreed(scores: DataFrame) -> DataFrame:
    """(qid): rows on which the pool's predictions differ."""
    votes = scores.groupBy(F.col("vec_id").alias("qid")).agg(F.countDistinct(F.col("score") >= 0.5).alias("_v"))
    return votes.filter(F.col("_v") > 1).select("qid")


def fit_selector(train: DataFrame) -> dict[int, tuple[float, list[float], list[float]]]:
    """Gaussian naive Bayes of "the model is right" on meta features: log prior,
    means and variances per class, from one aggregate (classes x features rows)."""
    right = ((F.col("score") >= 0.5).cast("int") == F.col("y_true")).cast("int")
    rows = train.select(right.alias("c"), F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("c", "i").collect()
    floor = 1e-9 * max((r["s"] for r in rows), default=0.0)
    total = sum(r["n"] for r in rows if r["i"] == 0)
    out = {}
    for c in {r["c"] for r in rows}:
        mine = [r for r in rows if r["c"] == c]
        out[c] = math.log(mine[0]["n"] / total), [r["m"] for r in mine], [max(r["s"] + floor, 1e-12) for r in mine]
    return out


def meta_des(selector: dict, meta: DataFrame) -> DataFrame:
    """Mean score of the models judged right (all of the pool if none is)."""

    def likelihood(c: int) -> Column:
        if c not in selector:
            return F.lit(float("-inf"))
        prior, means, variances = selector[c]
        normal = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(v).alias("v"), F.lit(math.log(2 * math.pi * v)).alias("l"))
                           for m, v in zip(means, variances)])
        parts = F.zip_with("x", normal, lambda x, g: (g["l"] + (x - g["m"]) * (x - g["m"]) / g["v"]) * -0.5)
        return F.aggregate(parts, F.lit(prior), lambda a, p: a + p)

    judged = meta.withColumn("_good", (likelihood(1) >= likelihood(0)).cast("int"))
    any_good = F.max("_good").over(Window.partitionBy("qid"))  # the pool of one row
    kept = judged.withColumn("_any", any_good).filter((F.col("_any") == 0) | (F.col("_good") == 1)).withColumn("w", F.lit(1.0))
    return kept.groupBy("qid").agg(_ordered_mean(False).alias("score"), F.count(F.lit(1)).alias("n_selected"))
