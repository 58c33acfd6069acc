"""Diversity and vote queries (D1-D10, M13, M14): diversity on val, subset
evaluation and votes on test, threshold 0.5."""

from __future__ import annotations

from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.operators import diversity as D
from retainlab.operators import evaluate as E
from retainlab.plans.q_evaluate import metric_sql
from retainlab.plans.registry import query
from retainlab.sources.fixtures import scores_long

MI = """
, mi AS (SELECT model, CAST(row_number() OVER (ORDER BY model) - 1 AS INTEGER) AS idx
         FROM (SELECT DISTINCT model FROM scores_long) m)
"""
CORR = MI + """
, cr AS (SELECT s.customerID, s.split, s.model, mi.idx, s.y_true, s.score,
                CAST((CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = y_true AS INTEGER) AS correct
         FROM scores_long s JOIN mi USING (model))
"""
PAIRS = CORR + """
, pc AS (SELECT a.model AS model_a, b.model AS model_b,
                count_if(a.correct = 1 AND b.correct = 1) AS n11, count_if(a.correct = 1 AND b.correct = 0) AS n10,
                count_if(a.correct = 0 AND b.correct = 1) AS n01, count_if(a.correct = 0 AND b.correct = 0) AS n00
         FROM cr a JOIN cr b ON a.customerID = b.customerID AND a.model < b.model
         WHERE a.split = 'val' AND b.split = 'val' GROUP BY a.model, b.model),
pdv AS (SELECT model_a, model_b,
               CASE WHEN CAST(n11 AS DOUBLE) * n00 + CAST(n01 AS DOUBLE) * n10 <> 0
                    THEN (CAST(n11 AS DOUBLE) * n00 - CAST(n01 AS DOUBLE) * n10)
                         / (CAST(n11 AS DOUBLE) * n00 + CAST(n01 AS DOUBLE) * n10) ELSE 0.0::DOUBLE END AS q_statistic,
               CAST(n10 + n01 AS DOUBLE) / (n11 + n10 + n01 + n00) AS disagreement,
               CAST(n00 AS DOUBLE) / (n11 + n10 + n01 + n00) AS double_fault
        FROM pc)
"""
SUBSETS = PAIRS + """
, arr AS (SELECT customerID, y_true, list(score ORDER BY model) AS s FROM scores_long WHERE split = 'val'
          GROUP BY customerID, y_true),
ms AS (SELECT CAST(m AS BIGINT) AS mask FROM range(1, 64) t(m)),
xv AS (SELECT ms.mask, arr.y_true,
              list_reduce(list_filter(s, lambda v, i: ((ms.mask >> (i - 1)) & 1) = 1), lambda a, b: a + b)
              / len(list_filter(s, lambda v, i: ((ms.mask >> (i - 1)) & 1) = 1)) AS avg
       FROM arr, ms),
sf AS (SELECT mask, {f1} AS f1 FROM (
         SELECT mask, count_if(y_true = 1 AND avg >= 0.5) AS tp, count_if(y_true = 0 AND avg >= 0.5) AS fp,
                count_if(y_true = 1 AND avg < 0.5) AS fn FROM xv GROUP BY mask) c)
""".replace("{f1}", metric_sql("f1"))
PATH = SUBSETS + """
, pq AS (SELECT a.idx AS ia, b.idx AS ib, q_statistic AS q FROM pdv JOIN mi a ON a.model = pdv.model_a
         JOIN mi b ON b.model = pdv.model_b
         UNION ALL SELECT b.idx, a.idx, q_statistic FROM pdv JOIN mi a ON a.model = pdv.model_a
         JOIN mi b ON b.model = pdv.model_b),
path AS (
  SELECT * FROM (SELECT 1 AS step, CAST(1 AS BIGINT) << mi.idx AS mask, sf.f1, mi.model
                 FROM mi JOIN sf ON sf.mask = CAST(1 AS BIGINT) << mi.idx ORDER BY sf.f1 DESC, mi.model LIMIT 1) s0
  UNION ALL
  SELECT p.step + 1, p.mask | c.bit, c.f1, c.model
  FROM path p, LATERAL (
    SELECT mi.model, CAST(1 AS BIGINT) << mi.idx AS bit, sf.f1,
           (SELECT avg(q) FROM pq WHERE pq.ia = mi.idx AND ((p.mask >> pq.ib) & 1) = 1) AS mq
    FROM mi JOIN sf ON sf.mask = p.mask | (CAST(1 AS BIGINT) << mi.idx)
    WHERE ((p.mask >> mi.idx) & 1) = 0 AND sf.f1 > p.f1
    ORDER BY mq, mi.model LIMIT 1) c
) /*recursive*/
"""


def _names(spark, sf_dir):
    return D.model_names(scores_long(spark, sf_dir).select("model"))


@query("correct_mask", CORR + """
SELECT customerID, CAST(sum(CAST(correct AS BIGINT) << idx) AS BIGINT) AS mask FROM cr WHERE split = 'val'
GROUP BY customerID
""")
def q_correct_mask(spark, sf_dir):
    s = scores_long(spark, sf_dir, "val")
    return D.correct_mask(s, _names(spark, sf_dir))


@query("pair_contingency", PAIRS + " SELECT * FROM pc")
def q_pair_contingency(spark, sf_dir):
    return D.pair_contingency(scores_long(spark, sf_dir, "val"), _names(spark, sf_dir))


@query("pairwise_diversity", PAIRS + """
SELECT model_a, model_b, round(q_statistic, 6) AS q_statistic, round(disagreement, 6) AS disagreement,
       round(double_fault, 6) AS double_fault FROM pdv
""")
def q_pairwise_diversity(spark, sf_dir):
    return D.pairwise_diversity(D.pair_contingency(scores_long(spark, sf_dir, "val"), _names(spark, sf_dir)))


@query("diversity_matrix", PAIRS + """
SELECT model_a, model_b, round(q_statistic, 6) AS value FROM pdv
UNION ALL SELECT model_b, model_a, round(q_statistic, 6) FROM pdv
UNION ALL SELECT model, model, 0.0::DOUBLE FROM mi
""")
def q_diversity_matrix(spark, sf_dir):
    names = _names(spark, sf_dir)
    pw = D.pairwise_diversity(D.pair_contingency(scores_long(spark, sf_dir, "val"), names))
    return D.diversity_matrix(pw, names)


@query("subset_vote_f1", SUBSETS + """
SELECT sf.mask, (SELECT string_agg(model, '+' ORDER BY model) FROM mi WHERE ((sf.mask >> mi.idx) & 1) = 1) AS models,
       CAST(bit_count(sf.mask) AS INTEGER) AS size, round(sf.f1, 6) AS f1
FROM sf
""")
def q_subset_vote_f1(spark, sf_dir):
    names = _names(spark, sf_dir)
    arrays = D.score_arrays(scores_long(spark, sf_dir, "val"), names)
    out = D.all_subset_f1(arrays, names)
    return out.select("mask", "models", "size", F.round("f1", 6).alias("f1"))


def _path(spark, sf_dir):
    names = _names(spark, sf_dir)
    val = scores_long(spark, sf_dir, "val")
    pw = D.pairwise_diversity(D.pair_contingency(val, names), digits=None)
    return D.select_diverse_subset(D.score_arrays(val, names), pw, names), names


@query("diverse_subset", PATH + """
SELECT CAST(step AS INTEGER) AS step, model, round(f1, 6) AS f1 FROM path
""")
def q_diverse_subset(spark, sf_dir):
    path, _ = _path(spark, sf_dir)
    rows = [(int(s), m, round(float(f), 6)) for s, m, f in path]
    return spark.createDataFrame(rows, "step int, model string, f1 double")


@query("subset_eval", PATH + f"""
, fin AS (SELECT mask FROM path ORDER BY step DESC LIMIT 1),
tsa AS (SELECT customerID, y_true, list(score ORDER BY model) AS s FROM scores_long WHERE split = 'test'
       GROUP BY customerID, y_true),
sv AS (SELECT customerID, y_true,
              list_reduce(list_filter(s, lambda v, i: ((fin.mask >> (i - 1)) & 1) = 1), lambda a, b: a + b)
              / len(list_filter(s, lambda v, i: ((fin.mask >> (i - 1)) & 1) = 1)) AS score
       FROM tsa, fin),
cm AS (SELECT count_if(y_true = 1 AND score >= 0.5) AS tp, count_if(y_true = 0 AND score >= 0.5) AS fp,
              count_if(y_true = 1 AND score < 0.5) AS fn, count_if(y_true = 0 AND score < 0.5) AS tn FROM sv),
pr AS (SELECT count_if(p.score > n.score) AS w, count_if(p.score = n.score) AS ties
       FROM sv p JOIN sv n ON p.y_true = 1 AND n.y_true = 0),
tg AS (SELECT score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM sv GROUP BY score),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg FROM tg)
SELECT (SELECT string_agg(model, '+' ORDER BY model) FROM mi, fin WHERE ((fin.mask >> mi.idx) & 1) = 1) AS models,
       round({metric_sql('f1')}, 6) AS f1, round({metric_sql('recall')}, 6) AS recall,
       round({metric_sql('precision')}, 6) AS precision, round({metric_sql('accuracy')}, 6) AS accuracy,
       (SELECT round(CAST(2 * w + ties AS DOUBLE) / (CAST(tp + fn AS DOUBLE) * CAST(fp + tn AS DOUBLE) * 2.0), 6) FROM pr)
         AS roc_auc,
       (SELECT round(sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / sum(pos), 6) FROM cu) AS pr_auc
FROM cm
""")
def q_subset_eval(spark, sf_dir):
    path, names = _path(spark, sf_dir)
    chosen = sorted(m for _, m, _ in path)
    test = scores_long(spark, sf_dir, "test").filter(F.col("model").isin(chosen))
    sv = D.soft_vote(D.score_arrays(test, chosen), chosen).withColumn("model", F.lit("+".join(chosen)))
    m = E.with_metrics(E.confusion(sv), ("f1", "recall", "precision", "accuracy")).drop("tp", "fp", "fn", "tn")
    out = m.join(E.curve_stats(sv), "model")
    return out.withColumnRenamed("model", "models")


@query("vote_soft", """
SELECT customerID, y_true, round(list_reduce(list(score ORDER BY model), lambda a, b: a + b) / count(*), 6) AS score,
       CAST(list_reduce(list(score ORDER BY model), lambda a, b: a + b) / count(*) >= 0.5 AS INTEGER) AS pred
FROM scores_long WHERE split = 'test' GROUP BY customerID, y_true
""")
def q_vote_soft(spark, sf_dir):
    s = scores_long(spark, sf_dir, "test")
    names = _names(spark, sf_dir)
    v = D.soft_vote(D.score_arrays(s, names), names)
    return v.withColumn("score", F.round("score", 6))


@query("vote_hard", """
SELECT customerID, y_true, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS votes, count(*) AS n_models,
       CAST(2 * sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) > count(*) AS INTEGER) AS pred
FROM scores_long WHERE split = 'test' GROUP BY customerID, y_true
""")
def q_vote_hard(spark, sf_dir):
    return D.hard_vote(scores_long(spark, sf_dir, "test"))
