"""Evaluation queries E1-E17 on the fixture score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from retainlab.operators import evaluate as E
from retainlab.plans.registry import query
from retainlab.sources.fixtures import scores_long


def _scores(spark, sf_dir, split):
    return scores_long(spark, sf_dir, split)


# ------------------------------------------------------------ SQL helpers
def _r(num, den):
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0::DOUBLE END"


def metric_sql(name, tp="tp", fp="fp", fn="fn", tn="tn"):
    if name == "accuracy":
        return _r(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}")
    if name == "precision":
        return _r(tp, f"{tp} + {fp}")
    if name == "recall":
        return _r(tp, f"{tp} + {fn}")
    if name == "f1":
        return _r(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    if name == "mcc":
        d = [f"CAST({x} AS DOUBLE)" for x in (tp, fp, fn, tn)]
        den = f"({d[0]} + {d[1]}) * ({d[0]} + {d[2]}) * ({d[3]} + {d[1]}) * ({d[3]} + {d[2]})"
        return f"CASE WHEN {den} > 0 THEN ({d[0]} * {d[3]} - {d[1]} * {d[2]}) / sqrt({den}) ELSE 0.0::DOUBLE END"
    raise ValueError(name)


METRICS = ("accuracy", "precision", "recall", "f1", "mcc")
ALL_METRICS_SQL = ", ".join(f"round({metric_sql(m)}, 6) AS {m}" for m in METRICS)


def conf_sql(split, t="0.5::DOUBLE"):
    return f"""
    SELECT model, count_if(y_true = 1 AND score >= {t}) AS tp, count_if(y_true = 0 AND score >= {t}) AS fp,
           count_if(y_true = 1 AND score < {t}) AS fn, count_if(y_true = 0 AND score < {t}) AS tn
    FROM scores_long WHERE split = '{split}' GROUP BY model"""


def grid_sql(start, stop, num):
    step = f"(({stop}::DOUBLE - {start}::DOUBLE) / {num - 1})"
    return (
        f"SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = {num - 1} THEN {stop}::DOUBLE "
        f"ELSE CAST(i AS DOUBLE) * {step} + {start}::DOUBLE END AS threshold FROM range({num}) t(i)"
    )


def sweep_sql(split, start, stop, num):
    return f"""
    , grid AS ({grid_sql(start, stop, num)}),
    sw AS (SELECT s.model, g.threshold,
                  count_if(y_true = 1 AND score >= g.threshold) AS tp, count_if(y_true = 0 AND score >= g.threshold) AS fp,
                  count_if(y_true = 1 AND score < g.threshold) AS fn, count_if(y_true = 0 AND score < g.threshold) AS tn
           FROM scores_long s, grid g WHERE s.split = '{split}' GROUP BY s.model, g.threshold)
    """


def ties_sql(split):
    return f"""
    , tg AS (SELECT model, score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg
             FROM scores_long WHERE split = '{split}' GROUP BY model, score),
    cu AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS cum_pos,
                     sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS cum_neg,
                     sum(pos) OVER (PARTITION BY model) AS p_all, sum(neg) OVER (PARTITION BY model) AS n_all
           FROM tg)
    """


# ---------------------------------------------------------------- queries
@query("margin_scale", """
, mm AS (SELECT model, min(pts) AS lo, max(pts) AS hi FROM scores_long GROUP BY model)
SELECT s.customerID, s.model,
       round(CASE WHEN hi > lo THEN (CAST(pts AS DOUBLE) - lo) / (hi - lo) ELSE 0.0::DOUBLE END, 6) AS scaled
FROM scores_long s JOIN mm USING (model)
""")
def q_margin_scale(spark, sf_dir):
    s = scores_long(spark, sf_dir).withColumn("margin", F.col("pts").cast("double"))
    out = E.minmax_scale(s, "margin")
    return out.select("customerID", "model", F.round("scaled", 6).alias("scaled"))


@query("confusion", conf_sql("test"))
def q_confusion(spark, sf_dir):
    return E.confusion(_scores(spark, sf_dir, "test"))


@query("binary_metrics", f"""
, c AS ({conf_sql('test')})
SELECT model, {", ".join(f"round({metric_sql(m)}, 6) AS {m}" for m in ("accuracy", "precision", "recall", "f1"))}
FROM c
""")
def q_binary_metrics(spark, sf_dir):
    c = E.confusion(_scores(spark, sf_dir, "test"))
    return E.with_metrics(c, ("accuracy", "precision", "recall", "f1")).drop("tp", "fp", "fn", "tn")


@query("mcc", f"""
, c AS ({conf_sql('test')})
SELECT model, round({metric_sql('mcc')}, 6) AS mcc FROM c
""")
def q_mcc(spark, sf_dir):
    c = E.confusion(_scores(spark, sf_dir, "test"))
    return E.with_metrics(c, ("mcc",)).select("model", "mcc")


@query("class_report", f"""
, c AS ({conf_sql('test')}),
cl AS (SELECT model, '0' AS label, tn AS tp, fn AS fp, fp AS fn, tn + fp AS support FROM c
       UNION ALL SELECT model, '1', tp, fp, fn, tp + fn FROM c),
m AS (SELECT model, label, support, {metric_sql('precision')} AS precision, {metric_sql('recall')} AS recall,
             {metric_sql('f1')} AS f1 FROM cl)
SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL
SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM m GROUP BY model
UNION ALL
SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m GROUP BY model
""")
def q_class_report(spark, sf_dir):
    return E.class_report(E.confusion(_scores(spark, sf_dir, "test")))


@query("roc_auc", """
, t AS (SELECT * FROM scores_long WHERE split = 'test'),
pr AS (SELECT p.model, count_if(p.score > n.score) AS w, count_if(p.score = n.score) AS ties
       FROM t p JOIN t n ON p.model = n.model AND p.y_true = 1 AND n.y_true = 0 GROUP BY p.model),
pn AS (SELECT model, count_if(y_true = 1) AS np, count_if(y_true = 0) AS nn FROM t GROUP BY model)
SELECT pn.model, round(CAST(2 * coalesce(w, 0) + coalesce(ties, 0) AS DOUBLE) / (CAST(np AS DOUBLE) * CAST(nn AS DOUBLE) * 2.0), 6)
       AS roc_auc
FROM pn LEFT JOIN pr USING (model)
""")
def q_roc_auc(spark, sf_dir):
    return E.roc_auc(_scores(spark, sf_dir, "test"))


@query("average_precision", ties_sql("test") + """
SELECT model, round(sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / sum(pos), 6) AS average_precision
FROM cu GROUP BY model
""")
def q_average_precision(spark, sf_dir):
    return E.average_precision(_scores(spark, sf_dir, "test"))


@query("roc_points", ties_sql("test") + """
SELECT model, score AS threshold, round(CAST(cum_neg AS DOUBLE) / n_all, 6) AS fpr,
       round(CAST(cum_pos AS DOUBLE) / p_all, 6) AS tpr FROM cu
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cu
""")
def q_roc_points(spark, sf_dir):
    return E.roc_points(_scores(spark, sf_dir, "test"))


@query("pr_points", ties_sql("test") + """
SELECT model, score AS threshold, round(CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg), 6) AS precision,
       round(CAST(cum_pos AS DOUBLE) / p_all, 6) AS recall, round(CAST(p_all AS DOUBLE) / (p_all + n_all), 6) AS base_rate
FROM cu WHERE cum_pos - pos < p_all
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE,
       round(CAST(p_all AS DOUBLE) / (p_all + n_all), 6) FROM cu
""")
def q_pr_points(spark, sf_dir):
    return E.pr_points(_scores(spark, sf_dir, "test"))


@query("threshold_sweep", sweep_sql("val", 0.001, 0.999, 999) + f"""
SELECT model, round(threshold, 6) AS threshold, tp, fp, fn, tn, {ALL_METRICS_SQL} FROM sw
""")
def q_threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(_scores(spark, sf_dir, "val"))


@query("best_threshold", sweep_sql("val", 0.001, 0.999, 999) + f"""
, lg AS (SELECT model, threshold, 'f1' AS metric, {metric_sql('f1')} AS value FROM sw
         UNION ALL SELECT model, threshold, 'mcc', {metric_sql('mcc')} FROM sw),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY value DESC, threshold) AS r
       FROM lg WHERE value > -1)
SELECT model, metric, round(threshold, 6) AS threshold, round(value, 6) AS value FROM rk WHERE r = 1
""")
def q_best_threshold(spark, sf_dir):
    return E.best_threshold(_scores(spark, sf_dir, "val"))


@query("error_cost", f"""
, c AS ({conf_sql('test')})
SELECT model, fn, fp, CAST(fn AS DOUBLE) * 500.0 + CAST(fp AS DOUBLE) * 50.0 AS cost FROM c
""")
def q_error_cost(spark, sf_dir):
    return E.error_cost(_scores(spark, sf_dir, "test"))


COST_CURVE_SQL = """
SELECT model, round(threshold, 6) AS threshold, fn, fp, CAST(fn AS DOUBLE) * 500.0 + CAST(fp AS DOUBLE) * 50.0 AS cost
FROM sw
"""


@query("cost_curve", sweep_sql("test", 0.01, 0.99, 99) + COST_CURVE_SQL)
def q_cost_curve(spark, sf_dir):
    return E.cost_curve(_scores(spark, sf_dir, "test"))


def _biz_sql(split):
    return sweep_sql(split, 0.01, 0.99, 99) + f"""
    , cc AS ({COST_CURVE_SQL}),
    bz AS (SELECT model, threshold, cost, row_number() OVER (PARTITION BY model ORDER BY cost, threshold) AS r FROM cc)
    """


@query("business_threshold", _biz_sql("val") + """
SELECT model, threshold, cost FROM bz WHERE r = 1
""")
def q_business_threshold(spark, sf_dir):
    return E.business_threshold(_scores(spark, sf_dir, "val"))


@query("cost_savings", sweep_sql("test", 0.01, 0.99, 99) + """
, cc AS (SELECT model, threshold, CAST(fn AS DOUBLE) * 500.0 + CAST(fp AS DOUBLE) * 50.0 AS cost FROM sw),
bz AS (SELECT model, threshold, cost, row_number() OVER (PARTITION BY model ORDER BY cost, threshold) AS r FROM cc),
df AS (SELECT model, cost AS cost_default,
              row_number() OVER (PARTITION BY model ORDER BY abs(threshold - 0.5), threshold) AS r FROM cc)
SELECT d.model, cost_default, round(bz.threshold, 6) AS best_threshold, bz.cost AS best_cost,
       cost_default - bz.cost AS savings,
       CASE WHEN cost_default > 0 THEN round((cost_default - bz.cost) / cost_default * 100, 4) ELSE 0.0::DOUBLE END
         AS savings_pct
FROM df d JOIN bz ON d.model = bz.model AND bz.r = 1 WHERE d.r = 1
""")
def q_cost_savings(spark, sf_dir):
    return E.cost_savings(_scores(spark, sf_dir, "test"))


@query("leaderboard", sweep_sql("val", 0.001, 0.999, 999) + f"""
, f1v AS (SELECT model, threshold AS t_f1, {metric_sql('f1')} AS val_f1, row_number() OVER (PARTITION BY model ORDER BY {metric_sql('f1')} DESC, threshold) AS r
          FROM sw),
grid2 AS ({grid_sql(0.01, 0.99, 99)}),
sw2 AS (SELECT s.model, g.threshold,
               count_if(y_true = 1 AND score < g.threshold) AS fn, count_if(y_true = 0 AND score >= g.threshold) AS fp
        FROM scores_long s, grid2 g WHERE s.split = 'val' GROUP BY s.model, g.threshold),
bzv AS (SELECT model, threshold AS biz_threshold,
               row_number() OVER (PARTITION BY model ORDER BY CAST(fn AS DOUBLE) * 500.0 + CAST(fp AS DOUBLE) * 50.0,
                                  threshold) AS r FROM sw2),
th AS (SELECT f1v.model, t_f1, val_f1, biz_threshold FROM f1v JOIN bzv ON f1v.model = bzv.model AND bzv.r = 1
       WHERE f1v.r = 1),
ct AS (SELECT s.model, th.t_f1, th.val_f1, th.biz_threshold,
              count_if(y_true = 1 AND score >= t_f1) AS tp, count_if(y_true = 0 AND score >= t_f1) AS fp,
              count_if(y_true = 1 AND score < t_f1) AS fn, count_if(y_true = 0 AND score < t_f1) AS tn,
              count_if((y_true = 1) = (score >= 0.5)) AS right_default, count(*) AS n_all,
              count_if(y_true = 1 AND score < biz_threshold) AS biz_fn,
              count_if(y_true = 0 AND score >= biz_threshold) AS biz_fp
       FROM scores_long s JOIN th ON s.model = th.model WHERE s.split = 'test' GROUP BY s.model, th.t_f1, th.val_f1, th.biz_threshold),
t AS (SELECT * FROM scores_long WHERE split = 'test'),
pr AS (SELECT p.model, count_if(p.score > n.score) AS w, count_if(p.score = n.score) AS ties
       FROM t p JOIN t n ON p.model = n.model AND p.y_true = 1 AND n.y_true = 0 GROUP BY p.model),
pn AS (SELECT model, count_if(y_true = 1) AS np, count_if(y_true = 0) AS nn FROM t GROUP BY model),
auc AS (SELECT pn.model, round(CAST(2 * coalesce(w, 0) + coalesce(ties, 0) AS DOUBLE)
                               / (CAST(np AS DOUBLE) * CAST(nn AS DOUBLE) * 2.0), 6) AS roc_auc
        FROM pn LEFT JOIN pr USING (model))
{ties_sql('test')}
, ap AS (SELECT model, round(sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / sum(pos), 6) AS pr_auc
         FROM cu GROUP BY model),
m AS (SELECT ct.model, round(t_f1, 6) AS t_f1, round(val_f1, 6) AS val_f1, round({metric_sql('f1')}, 6) AS f1, round({metric_sql('recall')}, 6) AS recall,
             round({metric_sql('precision')}, 6) AS precision, round(CAST(right_default AS DOUBLE) / n_all, 6) AS accuracy,
             round(biz_threshold, 6) AS biz_threshold, CAST(biz_fn AS DOUBLE) * 500.0 + CAST(biz_fp AS DOUBLE) * 50.0 AS biz_cost,
             auc.roc_auc, ap.pr_auc
      FROM ct JOIN auc ON ct.model = auc.model JOIN ap ON ct.model = ap.model)
SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY val_f1 DESC, model) = 1 AS is_best
FROM m
""")
def q_leaderboard(spark, sf_dir):
    return E.leaderboard(_scores(spark, sf_dir, "val"), _scores(spark, sf_dir, "test"))
