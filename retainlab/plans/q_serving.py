"""Serving queries: train, tune, save, load and score (S8, S9, B1), the customer
record (B23) and the totals of the top customers by revenue at risk (B17)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.operators import boosting as B
from retainlab.operators import evaluate as E
from retainlab.operators import portfolio as P
from retainlab.plans.q_portfolio import _INTERVENTIONS_SQL, scored_portfolio
from retainlab.plans.q_prepare import prepared_input
from retainlab.plans.q_trees import _prepared
from retainlab.plans.registry import query
from retainlab.session import scratch_path
from retainlab.sources import store as ST
from retainlab.sources.tables import read_table


def train_served(spark: SparkSession, sf_dir: str) -> ST.Served:
    """The second-order booster with thresholds tuned on the validation rows."""
    v, train, prep = _prepared(spark, sf_dir)
    model = B.fit_boosted(train, B.SECOND_ORDER, F.col("pos_weight"))
    val = B.score_boosted(v.filter(F.col("split") == "val"), model).withColumn("model", F.lit("second_order"))
    tuned = {r["metric"]: r["threshold"] for r in E.best_threshold(val, digits=None).collect()}
    biz = E.business_threshold(val, digits=None).first()["threshold"]
    info = {"name": "second_order", "threshold_f1": tuned["f1"], "threshold_mcc": tuned["mcc"], "threshold_biz": biz, "features": prep.names}
    return ST.Served(prep.model, model, info)


def served_portfolio(served: ST.Served, profiles: DataFrame) -> DataFrame:
    """Every customer scored by a loaded model, flagged at its tuned threshold."""
    scored = served.score(profiles).select("k", "score")
    keyed = profiles.withColumn("TotalCharges", F.col("TotalCharges").cast("string"))
    return P.build_portfolio(keyed, scored, served.info["threshold_f1"])


@query("portfolio_served")
def q_portfolio_served(spark, sf_dir):
    """B1: train, tune, save, load, score all customers, write the portfolio by
    tier and read it back."""
    folder = scratch_path(spark, f"serving-{uuid.uuid4().hex[:8]}")
    ST.save_model(spark, f"{folder}/model", train_served(spark, sf_dir))
    served = ST.load_model(spark, f"{folder}/model")
    ST.write_by_tier(served_portfolio(served, prepared_input(spark, sf_dir)), f"{folder}/portfolio")
    out = ST.read_by_tier(spark, f"{folder}/portfolio")
    return out.select(C.ID_COL, F.round("churn_probability", 4).alias("churn_probability"), "risk_tier", "predicted_churn",
                      F.lit(served.info["threshold_f1"]).alias("threshold"))


@query("model_round_trip", """
, dd AS (SELECT min(k) AS k FROM (SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM ps)
         GROUP BY """ + ", ".join(C.FEATURE_COLUMNS) + """, y_true)
SELECT count(*) AS n_scored, 0::BIGINT AS n_different, true AS same_thresholds FROM dd
""")
def q_model_round_trip(spark, sf_dir):
    """Scores of a saved and loaded model against those of the fitted one,
    over all customers."""
    fitted = train_served(spark, sf_dir)
    folder = scratch_path(spark, f"serving-{uuid.uuid4().hex[:8]}/model")
    ST.save_model(spark, folder, fitted)
    loaded = ST.load_model(spark, folder)
    rows = prepared_input(spark, sf_dir)
    both = fitted.score(rows).select("k", F.col("score").alias("a")).join(loaded.score(rows).select("k", F.col("score").alias("b")), "k")
    same = all(loaded.info[t] == fitted.info[t] for t in ("threshold_f1", "threshold_mcc", "threshold_biz"))
    return both.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different")).withColumn(
        "same_thresholds", F.lit(same))


@query("revenue_top50_totals", """
, top AS (SELECT * FROM pf ORDER BY revenue_at_risk DESC, customerID LIMIT 50)
SELECT count(*) AS n, round(sum(revenue_at_risk), 2) AS top_revenue_at_risk, round(sum(annual_revenue), 2) AS top_annual_revenue
FROM top
""")
def q_revenue_top50_totals(spark, sf_dir):
    return P.revenue_top_totals(scored_portfolio(spark, sf_dir), 50)


@query("customer_detail", _INTERVENTIONS_SQL + """
, req AS (SELECT c_name AS customerID FROM customer),
ia AS (SELECT customerID, string_agg(action, '|' ORDER BY o) AS interventions, round(sum(estimated_cost), 4) AS intervention_cost
       FROM iv GROUP BY customerID)
SELECT req.customerID, """ + ", ".join(f"pf.{c}" for c in C.FEATURE_COLUMNS if c != "TotalCharges") + """,
       pf.TotalCharges, round(pf.churn_probability, 4) AS churn_probability, pf.risk_tier, pf.predicted_churn = 1 AS predicted_churn,
       pf.Churn AS actual_churn, round(pf.annual_revenue, 2) AS annual_revenue, pf.lifetime_months,
       round(pf.revenue_at_risk, 2) AS revenue_at_risk, coalesce(ia.interventions, '') AS interventions,
       coalesce(ia.intervention_cost, 0.0) AS intervention_cost, pf.risk_tier IS NOT NULL AS found
FROM req LEFT JOIN pf ON req.customerID = pf.customerID LEFT JOIN ia ON req.customerID = ia.customerID
""")
def q_customer_detail(spark, sf_dir):
    req = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias(C.ID_COL))
    return P.customer_detail(scored_portfolio(spark, sf_dir), req)
