"""Calibration queries C1-C8: metrics on test, calibrators fitted on val."""

from __future__ import annotations

from pyspark.sql import functions as F

from retainlab.operators import calibrate as CA
from retainlab.operators import evaluate as E
from retainlab.plans.q_evaluate import conf_sql, metric_sql, ties_sql
from retainlab.plans.registry import query
from retainlab.sources.fixtures import scores_long

EDGES = """
, ed AS (SELECT CAST(i AS INTEGER) AS b, CASE WHEN i = 10 THEN 1.0::DOUBLE ELSE CAST(i AS DOUBLE) * (1.0::DOUBLE / 10) END AS e
         FROM range(11) t(i))
"""


@query("ece", EDGES + """
, t AS (SELECT * FROM scores_long WHERE split = 'test'),
bn AS (SELECT t.model, t.score, t.y_true, (SELECT min(b) FROM ed WHERE ed.b >= 1 AND t.score <= ed.e) AS bin
       FROM t WHERE t.score > 0
       UNION ALL SELECT model, score, y_true, NULL FROM t WHERE score <= 0),
per AS (SELECT model, bin, count(*) AS n, avg(score) AS conf, avg(y_true) AS acc FROM bn GROUP BY model, bin),
tot AS (SELECT model, sum(n) AS a FROM per GROUP BY model)
SELECT per.model, round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN n / a * abs(acc - conf) END), 0.0), 6) AS ece
FROM per JOIN tot USING (model) GROUP BY per.model
""")
def q_ece(spark, sf_dir):
    return CA.ece(scores_long(spark, sf_dir, "test"))


@query("brier", """
SELECT model, round(avg((score - y_true) * (score - y_true)), 6) AS brier FROM scores_long WHERE split = 'test'
GROUP BY model
""")
def q_brier(spark, sf_dir):
    return CA.brier(scores_long(spark, sf_dir, "test"))


@query("reliability", EDGES + """
, t AS (SELECT * FROM scores_long WHERE split = 'test'),
bn AS (SELECT t.*, (SELECT CAST(count(*) AS INTEGER) FROM ed WHERE ed.b BETWEEN 1 AND 9 AND ed.e < t.score) AS bin FROM t)
SELECT model, bin, round(avg(score), 6) AS mean_predicted, round(avg(y_true), 6) AS fraction_positives, count(*) AS count
FROM bn GROUP BY model, bin
""")
def q_reliability(spark, sf_dir):
    return CA.reliability(scores_long(spark, sf_dir, "test"))


METRICS = ["f1", "recall", "precision", "roc_auc", "pr_auc"]


def _metrics_row(scores):
    m = E.with_metrics(E.confusion(scores), ("f1", "recall", "precision")).drop("tp", "fp", "fn", "tn")
    return m.join(E.curve_stats(scores), "model")


@query("metric_delta", ties_sql("test") + f"""
, c AS ({conf_sql('test')}),
t AS (SELECT * FROM scores_long WHERE split = 'test'),
pr AS (SELECT p.model, count_if(p.score > n.score) AS w, count_if(p.score = n.score) AS ties
       FROM t p JOIN t n ON p.model = n.model AND p.y_true = 1 AND n.y_true = 0 GROUP BY p.model),
m AS (SELECT c.model, round({metric_sql('f1')}, 6) AS f1, round({metric_sql('recall')}, 6) AS recall,
             round({metric_sql('precision')}, 6) AS precision,
             round(CAST(2 * w + ties AS DOUBLE) / (CAST(tp + fn AS DOUBLE) * CAST(fp + tn AS DOUBLE) * 2.0), 6) AS roc_auc,
             (SELECT round(sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / sum(pos), 6) FROM cu
              WHERE cu.model = c.model) AS pr_auc
      FROM c JOIN pr ON pr.model = c.model),
lg AS (SELECT model, metric, value FROM m UNPIVOT (value FOR metric IN (f1, recall, precision, roc_auc, pr_auc)))
SELECT a.metric, a.value AS original, b.value AS calibrated, round(b.value - a.value, 6) AS delta
FROM lg a JOIN lg b ON a.metric = b.metric AND a.model = 'm2' AND b.model = 'm1'
""")
def q_metric_delta(spark, sf_dir):
    """Original (scorer m2) against a better-calibrated variant (scorer m1)."""
    s = scores_long(spark, sf_dir, "test")
    m = _metrics_row(s)
    return CA.metric_delta(m.filter(F.col("model") == "m2"), m.filter(F.col("model") == "m1"), "model", METRICS)


# tie groups of val; isotonic shares by the min-max formula; Newton steps of Platt's fit
MAPS = """/*recursive*/
, g AS (SELECT model, score, count(*) AS n, sum(y_true) AS pos,
               row_number() OVER (PARTITION BY model ORDER BY score) AS i
        FROM scores_long WHERE split = 'val' GROUP BY model, score),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM g WINDOW w AS (PARTITION BY model ORDER BY score)),
spans AS (SELECT a.model, a.i AS j, b.i AS k, CAST(b.cp - a.cp + a.pos AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m
          FROM cum a JOIN cum b ON a.model = b.model AND a.i <= b.i),
least_after AS (SELECT model, k AS i, min(m) OVER (PARTITION BY model, j ORDER BY k DESC) AS y FROM spans),
iso AS (SELECT g.model, g.score AS x, max(l.y) AS y FROM g JOIN least_after l ON g.model = l.model AND g.i = l.i
        GROUP BY g.model, g.score),
tot AS (SELECT model, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) - sum(pos) AS DOUBLE) AS q FROM g GROUP BY model),
aims AS (SELECT g.model, g.score AS x, CAST(n AS DOUBLE) AS n,
                pos * ((p + 1) / (p + 2)) + (n - pos) * (1 / (q + 2)) AS aim FROM g JOIN tot USING (model)),
newton AS (
  SELECT model, 0 AS step, 0.0::DOUBLE AS a, ln((p + 1) / (q + 1)) AS b FROM tot
  UNION ALL
  SELECT model, step + 1,
         CASE WHEN haa * hbb - hab * hab > 1e-12 * haa * hbb THEN a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) ELSE a END,
         CASE WHEN haa * hbb - hab * hab > 1e-12 * haa * hbb THEN b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
              ELSE b - gb / hbb END  -- one score only
  FROM (SELECT w.model, w.step, w.a, w.b, sum(gap * x) AS ga, sum(gap) AS gb, sum(cv * x * x) AS haa, sum(cv * x) AS hab,
               sum(cv) AS hbb
        FROM (SELECT c.model, c.step, c.a, c.b, s.x, s.n / (1 + exp(-(c.a * s.x + c.b))) - s.aim AS gap,
                     s.n / (1 + exp(-(c.a * s.x + c.b))) * (1 - 1 / (1 + exp(-(c.a * s.x + c.b)))) AS cv
              FROM newton c JOIN aims s ON c.model = s.model WHERE c.step < 12) w
        GROUP BY w.model, w.step, w.a, w.b) v
),
platt AS (SELECT model, a, b FROM newton WHERE step = 12),
t AS (SELECT * FROM scores_long WHERE split = 'test'),
by_platt AS (SELECT t.customerID, t.model, t.y_true, 1 / (1 + exp(-(a * t.score + b))) AS score FROM t JOIN platt USING (model)),
lower_ AS (SELECT t.customerID, t.model, t.y_true, t.score, iso.x AS x0, iso.y AS y0
           FROM t ASOF LEFT JOIN iso ON t.model = iso.model AND t.score >= iso.x),
by_iso AS (SELECT l.customerID, l.model, l.y_true,
                  CASE WHEN x0 IS NULL THEN u.y WHEN u.x IS NULL OR u.x = x0 THEN y0
                       ELSE y0 + (u.y - y0) * (l.score - x0) / (u.x - x0) END AS score
           FROM lower_ l ASOF LEFT JOIN iso u ON l.model = u.model AND l.score <= u.x)
"""


@query("platt", MAPS + "SELECT customerID, model, y_true, round(score, 6) AS score FROM by_platt")
def q_platt(spark, sf_dir):
    """Platt scaling fitted on val for every model, applied to test."""
    groups = CA.score_groups(scores_long(spark, sf_dir, "val")).checkpoint()
    out = CA.apply_platt_maps(scores_long(spark, sf_dir, "test"), CA.platt_maps(groups))
    return out.select("customerID", "model", "y_true", F.round("score", 6).alias("score"))


@query("isotonic", MAPS + "SELECT customerID, model, y_true, round(score, 6) AS score FROM by_iso")
def q_isotonic(spark, sf_dir):
    """Isotonic calibration fitted on val for every model, applied to test."""
    groups = CA.score_groups(scores_long(spark, sf_dir, "val"))
    out = CA.apply_isotonic_maps(scores_long(spark, sf_dir, "test"), CA.isotonic_maps(groups))
    return out.select("customerID", "model", "y_true", F.round("score", 6).alias("score"))


@query("calibration_summary", EDGES + MAPS + """
, v AS (SELECT model, 'original' AS variant, y_true, score FROM t
        UNION ALL SELECT model, 'platt', y_true, score FROM by_platt
        UNION ALL SELECT model, 'isotonic', y_true, score FROM by_iso),
bn AS (SELECT model, variant, score, y_true, (SELECT min(b) FROM ed WHERE ed.b >= 1 AND v.score <= ed.e) AS bin
       FROM v WHERE v.score > 0
       UNION ALL SELECT model, variant, score, y_true, NULL FROM v WHERE score <= 0),
per AS (SELECT model, variant, bin, count(*) AS n, avg(score) AS conf, avg(y_true) AS acc FROM bn GROUP BY model, variant, bin),
al AS (SELECT model, variant, sum(n) AS a FROM per GROUP BY model, variant),
e AS (SELECT model, variant, round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN n / a * abs(acc - conf) END), 0.0), 6) AS ece
      FROM per JOIN al USING (model, variant) GROUP BY model, variant),
br AS (SELECT model, variant, round(avg((score - y_true) * (score - y_true)), 6) AS brier FROM v GROUP BY model, variant)
SELECT model, variant, ece, brier FROM e JOIN br USING (model, variant)
""")
def q_calibration_summary(spark, sf_dir):
    """ECE and Brier per model x variant (original, platt, isotonic)."""
    val, test = scores_long(spark, sf_dir, "val"), scores_long(spark, sf_dir, "test")
    allv = CA.calibrate_by_model(val, test).checkpoint()  # two metrics read it
    return CA.ece(allv, group=("model", "variant")).join(CA.brier(allv, group=("model", "variant")),
                                                         ["model", "variant"])
