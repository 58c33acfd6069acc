"""Evaluation aggregates over a long score table.

Input: ``scores(model, y_true, score, ...)`` with one row per scored row and
model. Every operator groups by ``model``; row-level work is one pass, and
anything ordered (curves) runs on tie groups via K1 or on at most T grid bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.functions import metrics as M
from retainlab.operators.blocks import grid_index, prefix_sums


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


# ------------------------------------------------------------------ E1 scores
def minmax_scale(df: DataFrame, value: str = "margin", group: str = "model") -> DataFrame:
    """Margins scaled to [0, 1] per model; a constant margin gives 0."""
    mm = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(F.broadcast(mm), group)  # one row per model
    den = F.col("_hi") - F.col("_lo")
    return j.withColumn(
        "scaled", F.when(den > 0, (F.col(value) - F.col("_lo")) / den).otherwise(F.lit(0.0))
    ).drop("_lo", "_hi")


# ------------------------------------------------------------- E3-E6 counts
def confusion(scores: DataFrame, threshold: float | Column = C.DEFAULT_THRESHOLD,
              group: str = "model") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col("score") >= t
    y = F.col("y_true") == 1
    return scores.groupBy(group).agg(
        _cnt(y & pred).alias("tp"),
        _cnt(~y & pred).alias("fp"),
        _cnt(y & ~pred).alias("fn"),
        _cnt(~y & ~pred).alias("tn"),
    )


def with_metrics(counts: DataFrame, names=("accuracy", "precision", "recall", "f1", "mcc"),
                 digits: int = 6) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({n: F.round(M.metric(n, tp, fp, fn, tn), digits) for n in names})


def class_report(counts: DataFrame, group: str = "model") -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted
    averages and accuracy, from the confusion counts (rows per model x label)."""
    return counts.sparkSession.sql(
        f"""
        WITH c AS (
          SELECT {group}, inline(array(
            named_struct('label', '0', 'tp', tn, 'fp', fn, 'fn', fp, 'support', tn + fp),
            named_struct('label', '1', 'tp', tp, 'fp', fp, 'fn', fn, 'support', tp + fn)))
          FROM {{counts}}
        ),
        m AS (
          SELECT {group}, label, support,
                 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0D END AS precision,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0D END AS recall,
                 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0D END AS f1
          FROM c
        )
        SELECT {group}, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1, support FROM m
        UNION ALL
        SELECT {group}, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
               sum(support) FROM m GROUP BY {group}
        UNION ALL
        SELECT {group}, 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
               sum(support) FROM m GROUP BY {group}
        """,
        counts=counts,
    )


# ----------------------------------------------------------- E7-E10 curves
def tie_groups(scores: DataFrame, group: str = "model") -> DataFrame:
    """Positives and negatives per (model, distinct score), cumulative from the
    highest score down (K1 over tie groups, not over rows)."""
    g = scores.groupBy(group, "score").agg(
        _cnt(F.col("y_true") == 1).alias("pos"), _cnt(F.col("y_true") != 1).alias("neg")
    )
    return prefix_sums(
        g, [-F.col("score")], {"pos": F.col("pos"), "neg": F.col("neg")}, group=[group], write=True
    )


def _area2() -> Column:
    """Twice the area of a tie group in pair counts; decimal, since products
    of two counts pass 64 bits at a few billion rows a class."""
    return F.col("neg").cast("decimal(19,0)") * (F.col("cum_pos") * 2 - F.col("pos")).cast("decimal(19,0)")


def roc_auc(scores: DataFrame, group: str = "model") -> DataFrame:
    """Trapezoid area with ties (Mann-Whitney), exact in integer arithmetic:
    AUC = sum(neg_i * (2 cum_pos_i - pos_i)) / (2 P N)."""
    t = tie_groups(scores, group)
    a = t.groupBy(group).agg(
        F.sum(_area2()).alias("_num"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    den = F.col("_p").cast("double") * F.col("_n").cast("double") * 2.0
    return a.select(group, F.when(den > 0, F.round(F.col("_num").cast("double") / den, 6)).alias("roc_auc"))


def average_precision(scores: DataFrame, group: str = "model") -> DataFrame:
    """AP = sum over thresholds of (R_n - R_(n-1)) P_n."""
    t = tie_groups(scores, group)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    a = t.groupBy(group).agg(
        F.sum(F.col("pos") * prec).alias("_num"), F.sum("pos").alias("_p")
    )
    return a.select(group, F.when(F.col("_p") > 0, F.round(F.col("_num") / F.col("_p"), 6)).alias("average_precision"))


def curve_stats(scores: DataFrame, group: str = "model") -> DataFrame:
    """ROC-AUC and average precision from one pass over the tie groups."""
    t = tie_groups(scores, group)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    a = t.groupBy(group).agg(
        F.sum(_area2()).alias("_num"),
        F.sum(F.col("pos") * prec).alias("_apn"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    den = F.col("_p").cast("double") * F.col("_n").cast("double") * 2.0
    return a.select(
        group,
        F.when(den > 0, F.round(F.col("_num").cast("double") / den, 6)).alias("roc_auc"),
        F.when(F.col("_p") > 0, F.round(F.col("_apn") / F.col("_p"), 6)).alias("pr_auc"),
    )


def roc_points(scores: DataFrame, group: str = "model") -> DataFrame:
    """All distinct-threshold ROC points plus the origin (threshold null)."""
    t = tie_groups(scores, group)
    tot = t.groupBy(group).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    j = t.join(F.broadcast(tot), group)  # one row per model
    pts = j.select(
        group,
        F.col("score").alias("threshold"),
        F.round(F.try_divide(F.col("cum_neg"), F.col("_n")), 6).alias("fpr"),
        F.round(F.try_divide(F.col("cum_pos"), F.col("_p")), 6).alias("tpr"),
    )
    origin = tot.select(group, F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_points(scores: DataFrame, group: str = "model") -> DataFrame:
    """Precision-recall points down to the first threshold with full recall,
    the end point (precision 1, recall 0), and the base rate per model."""
    t = tie_groups(scores, group)
    tot = t.groupBy(group).agg(F.sum("pos").alias("_p"), (F.sum("pos") + F.sum("neg")).alias("_all"))
    j = t.join(F.broadcast(tot), group).filter(F.col("cum_pos") - F.col("pos") < F.col("_p"))
    base = F.round(F.col("_p") / F.col("_all"), 6).alias("base_rate")
    pts = j.select(
        group,
        F.col("score").alias("threshold"),
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(F.try_divide(F.col("cum_pos"), F.col("_p")), 6).alias("recall"),
        base,
    )
    end = tot.select(group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"), base)
    return pts.unionByName(end)


# -------------------------------------------------------- E11-E15 sweeps
def sweep_counts(scores: DataFrame, start: float, stop: float, num: int, group: str = "model") -> DataFrame:
    """Confusion counts at every grid threshold (numpy linspace) in one pass:
    bin each score to its grid index, then suffix sums over <= num+1 bins."""
    spark = scores.sparkSession
    idx = grid_index(F.col("score"), start, stop, num)
    h = scores.groupBy(group, idx.alias("j")).agg(
        _cnt(F.col("y_true") == 1).alias("pos"), _cnt(F.col("y_true") != 1).alias("neg")
    )
    tot = h.groupBy(group).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    step = (stop - start) / (num - 1)
    grid = spark.range(num).select(
        F.col("id").cast("int").alias("i"),
        F.when(F.col("id") == num - 1, F.lit(float(stop)))
        .otherwise(F.col("id").cast("double") * F.lit(step) + F.lit(start)).alias("threshold"),
    )
    # bins j = 1..num: a row with index j is predicted positive for thresholds i < j
    dense = tot.crossJoin(F.broadcast(grid)).withColumn("j", F.col("i") + 1)
    dense = dense.join(h, [group, "j"], "left").fillna(0, subset=["pos", "neg"])
    suffix = Window.partitionBy(group).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = dense.select(
        group,
        "threshold",
        F.sum("pos").over(suffix).alias("tp"),
        F.sum("neg").over(suffix).alias("fp"),
        "_p",
        "_n",
    )
    return out.select(
        group,
        "threshold",
        "tp",
        "fp",
        (F.col("_p") - F.col("tp")).alias("fn"),
        (F.col("_n") - F.col("fp")).alias("tn"),
    )


def threshold_sweep(scores: DataFrame, start: float = 0.001, stop: float = 0.999, num: int = 999,
                    group: str = "model") -> DataFrame:
    c = with_metrics(sweep_counts(scores, start, stop, num, group))
    return c.withColumn("threshold", F.round("threshold", 6))


def best_threshold(scores: DataFrame, metrics=("f1", "mcc"), start: float = 0.001, stop: float = 0.999,
                   num: int = 999, group: str = "model", digits: int | None = 6) -> DataFrame:
    """First best threshold per model and metric (strict improvement from -1,
    so ties keep the smallest threshold; nothing above -1 keeps 0.5)."""
    c = sweep_counts(scores, start, stop, num, group)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    longs = c.select(
        group,
        "threshold",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), M.metric(m, tp, fp, fn, tn).alias("value"))
                           for m in metrics])),
    )
    best = longs.filter(F.col("value") > -1).groupBy(group, "metric").agg(
        F.max_by(F.struct("threshold", "value"), F.struct(F.col("value"), -F.col("threshold"))).alias("b")
    )
    t = F.col("b.threshold") if digits is None else F.round("b.threshold", digits)
    v = F.col("b.value") if digits is None else F.round("b.value", digits)
    return best.select(group, "metric", t.alias("threshold"), v.alias("value"))


def cost_curve(scores: DataFrame, cost_fn: float = C.COST_FN, cost_fp: float = C.COST_FP,
               start: float = 0.01, stop: float = 0.99, num: int = 99, group: str = "model",
               digits: int | None = 6) -> DataFrame:
    c = sweep_counts(scores, start, stop, num, group)
    t = F.col("threshold") if digits is None else F.round("threshold", digits)
    return c.select(
        group,
        t.alias("threshold"),
        "fn",
        "fp",
        M.cost(F.col("fn"), F.col("fp"), cost_fn, cost_fp).alias("cost"),
    )


def business_threshold(scores: DataFrame, cost_fn: float = C.COST_FN, cost_fp: float = C.COST_FP,
                       start: float = 0.01, stop: float = 0.99, num: int = 99, group: str = "model",
                       digits: int | None = 6) -> DataFrame:
    """First cost-minimal grid threshold per model."""
    c = cost_curve(scores, cost_fn, cost_fp, start, stop, num, group, digits=None)
    b = c.groupBy(group).agg(F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("b"))
    t = F.col("b.threshold") if digits is None else F.round("b.threshold", digits)
    return b.select(group, t.alias("threshold"), F.col("b.cost").alias("cost"))


def error_cost(scores: DataFrame, threshold: float = C.DEFAULT_THRESHOLD, cost_fn: float = C.COST_FN,
               cost_fp: float = C.COST_FP, group: str = "model") -> DataFrame:
    c = confusion(scores, threshold, group)
    return c.select(group, "fn", "fp", M.cost(F.col("fn"), F.col("fp"), cost_fn, cost_fp).alias("cost"))


def cost_savings(scores: DataFrame, cost_fn: float = C.COST_FN, cost_fp: float = C.COST_FP,
                 group: str = "model") -> DataFrame:
    """Best curve cost against the curve cost at the grid point nearest 0.5,
    both picked from one cost curve (<= 99 rows per model)."""
    c = cost_curve(scores, cost_fn, cost_fp, group=group, digits=None)
    near = F.struct(F.abs(F.col("threshold") - F.lit(C.DEFAULT_THRESHOLD)), F.col("threshold"))
    j = c.groupBy(group).agg(
        F.min_by("cost", near).alias("cost_default"),
        F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("b"),
    )
    sav = F.col("cost_default") - F.col("b.cost")
    return j.select(
        group,
        "cost_default",
        F.round("b.threshold", 6).alias("best_threshold"),
        F.col("b.cost").alias("best_cost"),
        sav.alias("savings"),
        F.when(F.col("cost_default") > 0, F.round(sav / F.col("cost_default") * 100, 4))
        .otherwise(F.lit(0.0)).alias("savings_pct"),
    )


def leaderboard(val: DataFrame, test: DataFrame, cost_fn: float = C.COST_FN, cost_fp: float = C.COST_FP,
                group: str = "model") -> DataFrame:
    """Per model: F1-tuned threshold from val, F1 / recall / precision at it
    on test, accuracy at the default threshold, ROC and AP on test,
    cost-optimal threshold from val with its test cost; ranked by test F1 (ties
    by name). The best model is the one with the highest F1 on val, so that
    test rows choose nothing."""
    tf1 = best_threshold(val, ("f1",), group=group, digits=None).select(
        group, F.col("threshold").alias("t_f1"), F.col("value").alias("val_f1"))
    biz = business_threshold(val, cost_fn, cost_fp, group=group, digits=None).select(
        group, F.col("threshold").alias("biz_threshold")
    )
    thr = tf1.join(biz, group)
    tj = test.join(F.broadcast(thr), group)  # one row per model
    y = F.col("y_true") == 1
    at_f1 = F.col("score") >= F.col("t_f1")
    at_biz = F.col("score") >= F.col("biz_threshold")
    at_default = F.col("score") >= F.lit(C.DEFAULT_THRESHOLD)
    c = tj.groupBy(group, "t_f1", "val_f1", "biz_threshold").agg(
        _cnt(y & at_f1).alias("tp"), _cnt(~y & at_f1).alias("fp"), _cnt(y & ~at_f1).alias("fn"),
        _cnt(~y & ~at_f1).alias("tn"),
        _cnt(y == at_default).alias("_right_default"), F.count(F.lit(1)).alias("_n"),
        _cnt(y & ~at_biz).alias("biz_fn"), _cnt(~y & at_biz).alias("biz_fp"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = c.select(
        group,
        F.round("t_f1", 6).alias("t_f1"),
        F.round("val_f1", 6).alias("val_f1"),
        F.round(M.f1(tp, fp, fn), 6).alias("f1"),
        F.round(M.recall(tp, fn), 6).alias("recall"),
        F.round(M.precision(tp, fp), 6).alias("precision"),
        F.round(F.col("_right_default") / F.col("_n"), 6).alias("accuracy"),  # at the default threshold
        F.round("biz_threshold", 6).alias("biz_threshold"),
        M.cost(F.col("biz_fn"), F.col("biz_fp"), cost_fn, cost_fp).alias("biz_cost"),
    )
    m = m.join(curve_stats(test, group), group)
    w = Window.orderBy(F.col("f1").desc(), F.col(group).asc())  # one row per model
    by_val = Window.orderBy(F.col("val_f1").desc(), F.col(group).asc())
    return m.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.row_number().over(by_val) == 1)
