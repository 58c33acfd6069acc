"""Classifier diversity and ensembles over a long score table.

K4: each scored row becomes one integer ``mask`` with bit i set when model i
(models sorted by name) is right at the threshold. Pair counts then come
from at most min(n, 2^m) mask groups instead of m^2/2 passes over the rows.
Pair counts group rows by the models that are right, for any number of models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.functions import metrics as M

def bit_set(mask: Column, i: Column) -> Column:
    """Bit i of mask (exact up to 52 bits)."""
    return (mask / F.pow(F.lit(2), i)).cast("bigint") % 2 == 1


def bit_value(i: Column) -> Column:
    return F.pow(F.lit(2), i).cast("bigint")


def model_names(scores: DataFrame, group: str = "model") -> list[str]:
    """Distinct model names (a list bounded by the model count)."""
    return sorted(r[0] for r in scores.select(group).distinct().collect())


def _index_table(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "model string, idx int")


def correctness(scores: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    pred = (F.col("score") >= F.lit(threshold)).cast("int")
    return scores.withColumn("pred", pred).withColumn("correct", (F.col("pred") == F.col("y_true")).cast("int"))


def correct_mask(scores: DataFrame, names: list[str], key: str = C.ID_COL,
                 threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    idx = _index_table(scores.sparkSession, names)
    c = correctness(scores, threshold).join(F.broadcast(idx), "model")  # m rows
    return c.groupBy(key).agg(
        F.sum(F.col("correct").cast("bigint") * bit_value(F.col("idx"))).alias("mask")
    )


def pair_table(spark, names: list[str]) -> DataFrame:
    rows = [(a, b, i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return spark.createDataFrame(rows, "model_a string, model_b string, ia int, ib int")


def pair_contingency(scores: DataFrame, names: list[str], key: str = C.ID_COL,
                     threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """N11, N10, N01, N00 of correctness for every unordered pair (a < b).

    Rows that the same models get right are counted together (at most 2^m
    groups, or one a row), whatever the number of models; a group then adds to
    every pair, combined before the shuffle."""
    spark = scores.sparkSession
    idx = _index_table(spark, names)
    c = correctness(scores, threshold).join(F.broadcast(idx), "model")  # m rows
    right = F.sort_array(F.collect_list(F.when(F.col("correct") == 1, F.col("idx"))))
    groups = c.groupBy(key).agg(right.alias("right")).groupBy("right").agg(F.count(F.lit(1)).alias("n"))
    x = groups.crossJoin(F.broadcast(pair_table(spark, names)))  # m^2 / 2 rows
    a, b = F.array_contains("right", F.col("ia")), F.array_contains("right", F.col("ib"))
    return x.groupBy("model_a", "model_b").agg(
        F.sum(F.when(a & b, F.col("n")).otherwise(0)).cast("bigint").alias("n11"),
        F.sum(F.when(a & ~b, F.col("n")).otherwise(0)).cast("bigint").alias("n10"),
        F.sum(F.when(~a & b, F.col("n")).otherwise(0)).cast("bigint").alias("n01"),
        F.sum(F.when(~a & ~b, F.col("n")).otherwise(0)).cast("bigint").alias("n00"),
    )


def q_statistic(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    n11, n10, n01, n00 = (c.cast("double") for c in (n11, n10, n01, n00))
    num = n11 * n00 - n01 * n10
    den = n11 * n00 + n01 * n10
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def pairwise_diversity(contingency: DataFrame, digits: int | None = 6) -> DataFrame:
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = (n11 + n10 + n01 + n00).cast("double")
    cols = {
        "q_statistic": q_statistic(n11, n10, n01, n00),
        "disagreement": (n10 + n01) / n,
        "double_fault": n00 / n,
    }
    return contingency.select(
        "model_a", "model_b",
        *[(v if digits is None else F.round(v, digits)).alias(k) for k, v in cols.items()],
    )


def diversity_matrix(pairwise: DataFrame, names: list[str], metric: str = "q_statistic") -> DataFrame:
    """Symmetric long matrix: both directions plus a zero diagonal."""
    spark = pairwise.sparkSession
    fwd = pairwise.select("model_a", "model_b", F.col(metric).alias("value"))
    back = pairwise.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"),
                           F.col(metric).alias("value"))
    diag = spark.createDataFrame([(n, n, 0.0) for n in names], "model_a string, model_b string, value double")
    return fwd.unionByName(back).unionByName(diag)


# ------------------------------------------------------------- ensembles
def score_arrays(scores: DataFrame, names: list[str], key: str = C.ID_COL) -> DataFrame:
    """One row per scored row: y_true and the scores in model-name order
    (a group of m rows per key, so per-key work is bounded by the model count)."""
    idx = _index_table(scores.sparkSession, names)
    s = scores.join(F.broadcast(idx), "model")
    g = s.groupBy(key, "y_true").agg(F.sort_array(F.collect_list(F.struct("idx", "score"))).alias("_s"))
    return g.select(key, "y_true", F.transform("_s", lambda x: x["score"]).alias("scores"))


def _subset_avg(scores_col: Column, mask: Column) -> Column:
    """Mean of the masked scores summed left to right in model order."""
    chosen = F.filter(scores_col, lambda x, i: bit_set(mask, i))
    total = F.aggregate(chosen, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.size(chosen)


def subset_f1(arrays: DataFrame, masks: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Soft-vote F1 of each model subset (bitmask); ``masks`` is a small table
    of candidate subsets (broadcast), so one pass scores all of them."""
    x = arrays.crossJoin(F.broadcast(masks))
    pred = _subset_avg(F.col("scores"), F.col("mask")) >= F.lit(threshold)
    y = F.col("y_true") == 1
    c = x.groupBy("mask").agg(
        F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"), F.count_if(y & ~pred).alias("fn")
    )
    return c.select("mask", M.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def all_subset_f1(arrays: DataFrame, names: list[str], threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    spark = arrays.sparkSession
    m = len(names)
    if m > 16:  # the subset table is broadcast and has 2^m - 1 rows
        raise ValueError("all-subset F1 needs 2^m rows; use select_diverse_subset for many models")
    masks = spark.createDataFrame(
        [(mask, "+".join(n for i, n in enumerate(names) if mask >> i & 1), bin(mask).count("1"))
         for mask in range(1, 2 ** m)],
        "mask bigint, models string, size int",
    )
    return subset_f1(arrays, masks.select("mask"), threshold).join(masks, "mask")


def select_diverse_subset(arrays: DataFrame, pairwise: DataFrame, names: list[str],
                          threshold: float = C.DEFAULT_THRESHOLD, max_k: int | None = None) -> list[tuple]:
    """Greedy forward selection. The loop runs over model names on the driver;
    each step is one aggregate that scores every candidate subset at once.

    Start: best single-model F1 (ties: first name). Candidates by ascending
    mean Q to the chosen set (ties: name); the first that raises soft-vote
    F1 joins; stop when none does or at ``max_k``.
    Returns [(step, model, f1)].
    """
    spark = arrays.sparkSession
    arrays = arrays.persist()
    q = {}
    for r in pairwise.select("model_a", "model_b", "q_statistic").collect():
        q[(r[0], r[1])] = q[(r[1], r[0])] = r[2]
    pos = {n: i for i, n in enumerate(names)}

    def f1_of(masks: list[int]) -> dict[int, float]:
        t = spark.createDataFrame([(mk,) for mk in masks], "mask bigint")
        return {r["mask"]: r["f1"] for r in subset_f1(arrays, t, threshold).collect()}

    single = f1_of([1 << i for i in range(len(names))])
    start = max(names, key=lambda n: single[1 << pos[n]])
    selected, mask = [start], 1 << pos[start]
    best = single[mask]
    path = [(1, start, best)]
    remaining = [n for n in names if n != start]
    while remaining and (max_k is None or len(selected) < max_k):
        def mean_q(c):
            vals = [q[(c, s)] for s in selected if (c, s) in q]
            return sum(vals) / len(vals) if vals else 1.0

        order = sorted(remaining, key=mean_q)
        trial = f1_of([mask | 1 << pos[c] for c in order])
        chosen = next((c for c in order if trial[mask | 1 << pos[c]] > best), None)
        if chosen is None:
            break
        selected.append(chosen)
        remaining.remove(chosen)
        mask |= 1 << pos[chosen]
        best = trial[mask]
        path.append((len(selected), chosen, best))
    arrays.unpersist()
    return path


def soft_vote(arrays: DataFrame, names: list[str], weights: dict[str, float] | None = None,
              threshold: float = C.DEFAULT_THRESHOLD, key: str = C.ID_COL) -> DataFrame:
    """Mean (or weighted mean) probability, summed in model order."""
    if weights:
        w = F.array(*[F.lit(float(weights.get(n, 0.0))) for n in names])
        num = F.aggregate(F.zip_with("scores", w, lambda s, x: s * x), F.lit(0.0), lambda a, x: a + x)
        avg = F.try_divide(num, F.lit(float(sum(weights.get(n, 0.0) for n in names))))
    else:
        avg = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    return arrays.select(key, "y_true", avg.alias("score"), (avg >= F.lit(threshold)).cast("int").alias("pred"))


def hard_vote(scores: DataFrame, threshold: float = C.DEFAULT_THRESHOLD, key: str = C.ID_COL) -> DataFrame:
    """Majority of 0/1 votes; a tie goes to class 0."""
    pred = (F.col("score") >= F.lit(threshold)).cast("int")
    g = scores.groupBy(key, "y_true").agg(F.sum(pred).alias("votes"), F.count(F.lit(1)).alias("n_models"))
    return g.withColumn("pred", (F.col("votes") * 2 > F.col("n_models")).cast("int"))
