"""Portfolio queries B1-B30 on the fixture portfolio (scorer m1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.functions.features import engineer_features
from retainlab.operators import portfolio as P
from retainlab.plans.registry import query
from retainlab.sources.fixtures import profile_split, risk_points_expr, scorer_points

BUDGET = 50000.0
OFFER_COST = 50.0
SEGMENT = {"contract": "Month-to-month", "internet_service": "Fiber optic", "min_tenure": 6,
           "max_monthly": 110.0}
SEARCH_PATTERN = "customer#0000001[0-4]"
STRATEGIES = [("A", "20% Discount", 50.0, 0.3), ("B", "Free Tech Support", 25.0, 0.2)]
SCENARIOS = [
    ("two_year_contract", "Two year", None, None),
    ("autopay", None, "Credit card (automatic)", None),
    ("tenure_72", None, None, 72),
]
# fixed linear attribution weights for B4 (a stated linear model)
FACTOR_WEIGHTS = {
    "SeniorCitizen": 0.3,
    "tenure": -0.04,
    "MonthlyCharges": 0.02,
    "TotalCharges": -0.0003,
    "AvgMonthlyCharge": 0.01,
    "ChargeIncrease": 0.05,
    "MonthlyToTotalRatio": 1.5,
    "IsNewCustomer": 0.6,
    "NumServices": -0.2,
    "HasSecurity": -0.5,
    "HasSupport": -0.45,
    "AutoPay": -0.35,
}


def scored_portfolio(spark: SparkSession, sf_dir: str, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    ps = profile_split(spark, sf_dir).withColumn("score", scorer_points("m1") / F.lit(1000.0))
    return P.build_portfolio(ps, None, threshold).drop("risk_pts", "m_cents")


def m1_score(df: DataFrame):
    """Scorer m1 re-evaluated on (possibly modified) feature columns."""
    pts = F.least(F.lit(1000), F.greatest(F.lit(0), risk_points_expr()))
    return pts / F.lit(1000.0)


# ----------------------------------------------------------------- SQL bits
LEVEL = "CASE WHEN {p} < 0.3 THEN 'low' WHEN {p} < 0.6 THEN 'medium' ELSE 'high' END"
REC = (
    f"CASE WHEN {{p}} < 0.3 THEN '{C.RECOMMENDATION_LOW}' WHEN {{p}} < 0.6 THEN "
    f"'{C.RECOMMENDATION_MEDIUM}' ELSE '{C.RECOMMENDATION_HIGH}' END"
)
PF_COLS = (
    "customerID, split, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines, "
    "InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, "
    "StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn"
)
RANKED_CAMPAIGN = f"""
, el AS (SELECT *, churn_probability * 500.0 - 50.0 AS expected_savings FROM portfolio
         WHERE churn_probability >= 0.0),
r AS (SELECT *, row_number() OVER (ORDER BY expected_savings DESC, customerID) AS rank
      FROM el WHERE expected_savings > 0),
t AS (SELECT * FROM r WHERE rank <= {int(BUDGET // OFFER_COST)})
"""
SEG_WHERE = (
    "Contract = 'Month-to-month' AND InternetService = 'Fiber optic' AND tenure >= 6 "
    "AND MonthlyCharges <= 110.0"
)
AT_RISK = """
, ar AS (SELECT *, row_number() OVER (ORDER BY revenue_at_risk DESC, customerID) AS rank,
                sum(revenue_at_risk) OVER (ORDER BY revenue_at_risk DESC, customerID) AS cum_rar
         FROM pf WHERE churn_probability >= 0.3),
strat AS (SELECT * FROM (VALUES ('A', '20% Discount', 50.0::DOUBLE, 0.3::DOUBLE),
                                ('B', 'Free Tech Support', 25.0::DOUBLE, 0.2::DOUBLE))
          v(slot, name, cost_per_customer, effectiveness)),
st AS (SELECT s.*, (SELECT count(*) FROM ar) AS total_at_risk,
              least(CAST(floor(50000.0 / cost_per_customer) AS BIGINT), (SELECT count(*) FROM ar)) AS n_take
       FROM strat s),
st2 AS (SELECT st.*, coalesce((SELECT cum_rar FROM ar WHERE ar.rank = st.n_take), 0.0) AS rar_sum FROM st)
"""


@query("portfolio", f"""
SELECT {PF_COLS}, round(churn_probability, 4) AS churn_probability, risk_tier, predicted_churn, lifetime_months
FROM portfolio
""")
def q_portfolio(spark, sf_dir):
    pf = scored_portfolio(spark, sf_dir)
    return pf.drop("k").withColumn("churn_probability", F.round("churn_probability", 4))


@query("risk_level", f"""
SELECT customerID, {LEVEL.format(p='churn_probability')} AS risk_level,
       {REC.format(p='churn_probability')} AS recommendation
FROM portfolio
""")
def q_risk_level(spark, sf_dir):
    return P.risk_levels(scored_portfolio(spark, sf_dir))


@query("score_requests", f"""
, req AS (SELECT *, CASE WHEN SeniorCitizen = 1 THEN 0.4::DOUBLE END AS threshold FROM portfolio)
SELECT customerID, round(churn_probability, 4) AS churn_probability,
       churn_probability >= coalesce(threshold, 0.5::DOUBLE) AS churn_prediction,
       {LEVEL.format(p='churn_probability')} AS risk_level,
       round(coalesce(threshold, 0.5::DOUBLE), 4) AS threshold_used,
       {REC.format(p='churn_probability')} AS recommended_action,
       CASE WHEN churn_probability >= coalesce(threshold, 0.5::DOUBLE) THEN 50.0::DOUBLE
            ELSE round(churn_probability * 500.0, 2) END AS expected_cost
FROM req
""")
def q_score_requests(spark, sf_dir):
    pf = scored_portfolio(spark, sf_dir)
    req = pf.withColumn("threshold", F.when(F.col("SeniorCitizen") == 1, F.lit(0.4)))
    return P.score_requests(req)


_FACTOR_SQL_FEATURES = {
    "SeniorCitizen": "CAST(SeniorCitizen AS DOUBLE)",
    "tenure": "CAST(tenure AS DOUBLE)",
    "MonthlyCharges": "MonthlyCharges",
    "TotalCharges": "TotalCharges",
    "AvgMonthlyCharge": "TotalCharges / greatest(tenure, 1)",
    "ChargeIncrease": "MonthlyCharges - TotalCharges / greatest(tenure, 1)",
    "MonthlyToTotalRatio": "MonthlyCharges / greatest(TotalCharges, 1)",
    "IsNewCustomer": "CAST(CASE WHEN tenure <= 6 THEN 1 ELSE 0 END AS DOUBLE)",
    "NumServices": (
        "CAST((OnlineSecurity = 'Yes')::INT + (OnlineBackup = 'Yes')::INT + (DeviceProtection = 'Yes')::INT"
        " + (TechSupport = 'Yes')::INT + (StreamingTV = 'Yes')::INT + (StreamingMovies = 'Yes')::INT AS DOUBLE)"
    ),
    "HasSecurity": "CAST((OnlineSecurity = 'Yes')::INT AS DOUBLE)",
    "HasSupport": "CAST((TechSupport = 'Yes')::INT AS DOUBLE)",
    "AutoPay": "CAST(contains(lower(PaymentMethod), 'automatic')::INT AS DOUBLE)",
}
_FACTOR_X = ",\n       ".join(f"{v} AS {k}" for k, v in _FACTOR_SQL_FEATURES.items())
_FACTOR_MEANS = ", ".join(f"avg({k}) AS {k}" for k in FACTOR_WEIGHTS)
_FACTOR_UNION = "\n  UNION ALL ".join(
    f"SELECT customerID, '{k}' AS feature, {w} * (x.{k} - m.{k}) AS value FROM x, m"
    for k, w in FACTOR_WEIGHTS.items()
)


@query("top_factors", f"""
, x AS (SELECT customerID, {_FACTOR_X} FROM portfolio),
m AS (SELECT {_FACTOR_MEANS} FROM x),
c AS ({_FACTOR_UNION}),
r AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(value) DESC, feature) AS rank FROM c)
SELECT customerID, rank, feature, round(value, 6) AS contribution,
       CASE WHEN value > 0 THEN 'increases churn' ELSE 'decreases churn' END AS direction
FROM r WHERE rank <= 8
""")
def q_top_factors(spark, sf_dir):
    pf = engineer_features(scored_portfolio(spark, sf_dir))
    names = list(FACTOR_WEIGHTS)
    x = pf.select(C.ID_COL, *[F.col(c).cast("double").alias(c) for c in names])
    means = x.agg(*[F.avg(c).alias(c) for c in names])
    return P.top_factors(x, FACTOR_WEIGHTS, means, 8)


@query("portfolio_summary", """
SELECT count(*) AS total_customers, count_if(Churn = 'Yes') AS actual_churn_count,
       round(count_if(Churn = 'Yes') / count(*), 4) AS actual_churn_rate,
       CAST(sum(predicted_churn) AS BIGINT) AS predicted_churn_count,
       round(avg(churn_probability), 4) AS avg_probability,
       round(sum(churn_probability) * 500.0, 2) AS total_expected_cost
FROM portfolio
""")
def q_portfolio_summary(spark, sf_dir):
    return P.portfolio_summary(scored_portfolio(spark, sf_dir))


@query("tier_breakdown", """
SELECT risk_tier, Contract, count(*) AS n, round(avg(MonthlyCharges), 2) AS avg_monthly_charges
FROM portfolio GROUP BY GROUPING SETS ((risk_tier), (risk_tier, Contract))
""")
def q_tier_breakdown(spark, sf_dir):
    return P.tier_breakdown(scored_portfolio(spark, sf_dir))


_HIST = """
, bins AS (SELECT CAST(i AS INTEGER) AS bin,
                  CAST(i AS DOUBLE) * ((hi0 - lo0) / 20.0) + lo0 AS lo,
                  CASE WHEN i + 1 >= 20 THEN hi0 ELSE CAST(i + 1 AS DOUBLE) * ((hi0 - lo0) / 20.0) + lo0 END AS hi
           FROM range(20) t(i), mm)
SELECT b.bin, round(b.lo, 2) AS lo, round(b.hi, 2) AS hi,
       (SELECT count(*) FROM vals WHERE x >= b.lo AND (x < b.hi OR (b.bin = 19 AND x <= b.hi))) AS count
FROM bins b
"""


@query("probability_histogram", """
, vals AS (SELECT churn_probability AS x FROM portfolio WHERE churn_probability BETWEEN 0 AND 1),
mm AS (SELECT 0.0::DOUBLE AS lo0, 1.0::DOUBLE AS hi0)
""" + _HIST)
def q_probability_histogram(spark, sf_dir):
    return P.probability_histogram(scored_portfolio(spark, sf_dir))


@query("customer_page", """
, f AS (SELECT * FROM portfolio WHERE risk_tier = 'high'),
pg AS (SELECT * FROM f ORDER BY MonthlyCharges DESC, customerID LIMIT 20 OFFSET 20)
SELECT customerID, gender, tenure, Contract, MonthlyCharges, TotalCharges, InternetService,
       round(churn_probability, 4) AS churn_probability, risk_tier, predicted_churn, Churn,
       (SELECT count(*) FROM f) AS total, 2 AS page, 20 AS per_page,
       CAST(((SELECT count(*) FROM f) + 20 - 1) // 20 AS BIGINT) AS total_pages
FROM pg
""")
def q_customer_page(spark, sf_dir):
    return P.customer_page(scored_portfolio(spark, sf_dir), page=2, per_page=20, tier="high",
                           sort_by="MonthlyCharges", sort_desc=True)


def _risk_sql(contract, internet, payment, tenure):
    return (
        f"(CASE {contract} WHEN 'Month-to-month' THEN 300 WHEN 'One year' THEN 60 ELSE 0 END)"
        f" + (CASE {internet} WHEN 'Fiber optic' THEN 180 WHEN 'DSL' THEN 60 ELSE 0 END)"
        f" + (CASE WHEN {payment} = 'Electronic check' THEN 140 ELSE 0 END) + (72 - {tenure}) * 4"
    )


@query("scenario_delta", f"""
, sc AS (SELECT * FROM (VALUES ('two_year_contract', 'Two year', NULL, NULL),
                               ('autopay', NULL, 'Credit card (automatic)', NULL),
                               ('tenure_72', NULL, NULL, 72)) v(scenario, c, pm, t)),
x AS (SELECT p.customerID, sc.scenario,
        CAST(least(1000, greatest(0, {_risk_sql('p.Contract', 'p.InternetService', 'p.PaymentMethod', 'p.tenure')})) AS DOUBLE) / 1000.0 AS p0,
        CAST(least(1000, greatest(0, {_risk_sql('coalesce(sc.c, p.Contract)', 'p.InternetService', 'coalesce(sc.pm, p.PaymentMethod)', 'coalesce(sc.t, p.tenure)')})) AS DOUBLE) / 1000.0 AS p1
      FROM portfolio p, sc)
SELECT customerID, scenario, round(p0, 4) AS p_original, round(p1, 4) AS p_modified,
       {LEVEL.format(p='p0')} AS level_original, {LEVEL.format(p='p1')} AS level_modified,
       round(p1 - p0, 4) AS delta, {REC.format(p='p1')} AS recommendation
FROM x
""")
def q_scenario_delta(spark, sf_dir):
    pf = scored_portfolio(spark, sf_dir)
    sc = spark.createDataFrame(SCENARIOS, "scenario string, Contract string, PaymentMethod string, tenure int")
    return P.scenario_delta(pf, sc, m1_score)


@query("campaign_targets", RANKED_CAMPAIGN + """
SELECT rank, customerID, round(churn_probability, 4) AS churn_probability, risk_tier, Contract,
       MonthlyCharges, round(expected_savings, 2) AS expected_savings
FROM t
""")
def q_campaign_targets(spark, sf_dir):
    return P.campaign_targets(scored_portfolio(spark, sf_dir), BUDGET, OFFER_COST, 0.0)


@query("campaign_top20", RANKED_CAMPAIGN + """
SELECT rank, customerID, round(churn_probability, 4) AS churn_probability, risk_tier, Contract,
       MonthlyCharges, round(expected_savings, 2) AS expected_savings
FROM t WHERE rank <= 20
""")
def q_campaign_top20(spark, sf_dir):
    """The first 20 targets of the campaign."""
    return P.campaign_top(scored_portfolio(spark, sf_dir), BUDGET, OFFER_COST, 0.0)


@query("campaign_summary", RANKED_CAMPAIGN + """
SELECT (SELECT count(*) FROM r) AS total_eligible, count(*) AS customers_targeted,
       round(count(*) * 50.0::DOUBLE, 2) AS campaign_cost,
       round(coalesce(sum(churn_probability), 0.0), 4) AS expected_retained,
       round(coalesce(sum(churn_probability), 0.0) * 500.0, 2) AS expected_savings,
       round(coalesce(sum(churn_probability), 0.0) * 500.0 - count(*) * 50.0::DOUBLE, 2) AS net_roi,
       CASE WHEN count(*) > 0 THEN round((coalesce(sum(churn_probability), 0.0) * 500.0 - count(*) * 50.0::DOUBLE)
            / (count(*) * 50.0::DOUBLE) * 100, 4) ELSE 0.0::DOUBLE END AS roi_pct
FROM t
""")
def q_campaign_summary(spark, sf_dir):
    return P.campaign_summary(scored_portfolio(spark, sf_dir), BUDGET, OFFER_COST, 0.0)


@query("campaign_breakdown", RANKED_CAMPAIGN + """
SELECT CASE WHEN grouping(risk_tier) = 0 THEN 'risk_tier' ELSE 'Contract' END AS dimension,
       coalesce(risk_tier, Contract) AS value, count(*) AS n
FROM t GROUP BY GROUPING SETS ((risk_tier), (Contract))
""")
def q_campaign_breakdown(spark, sf_dir):
    return P.campaign_breakdown(scored_portfolio(spark, sf_dir), BUDGET, OFFER_COST, 0.0)


@query("campaign_roi_curve", RANKED_CAMPAIGN + """
, lv AS (SELECT CAST(pct AS INTEGER) AS budget_pct, 50000.0::DOUBLE * pct / 100 AS budget,
                CAST(floor(50000.0::DOUBLE * pct / 100 / 50.0) AS BIGINT) AS n_offers
         FROM range(5, 105, 5) t(pct)),
lv2 AS (SELECT *, least(n_offers, (SELECT count(*) FROM r)) AS n_take FROM lv)
SELECT budget_pct, round(budget, 2) AS budget, n_take AS customers_targeted,
       round(coalesce((SELECT sum(churn_probability) FROM r WHERE r.rank <= lv2.n_take), 0.0) * 500.0, 2) AS expected_savings,
       round(n_take * 50.0::DOUBLE, 2) AS campaign_cost,
       round(coalesce((SELECT sum(churn_probability) FROM r WHERE r.rank <= lv2.n_take), 0.0) * 500.0
             - n_take * 50.0::DOUBLE, 2) AS net_roi
FROM lv2
""")
def q_campaign_roi_curve(spark, sf_dir):
    return P.campaign_roi_curve(scored_portfolio(spark, sf_dir), BUDGET, OFFER_COST, 0.0)


@query("revenue_at_risk", """
SELECT round(sum(revenue_at_risk), 2) AS total_revenue_at_risk,
       round(sum(annual_revenue), 2) AS total_annual_revenue,
       CASE WHEN sum(annual_revenue) > 0 THEN round(sum(revenue_at_risk) / sum(annual_revenue) * 100, 4)
            ELSE 0.0::DOUBLE END AS pct_revenue_at_risk
FROM pf
""")
def q_revenue_at_risk(spark, sf_dir):
    return P.revenue_at_risk(scored_portfolio(spark, sf_dir))


@query("revenue_top50", """
SELECT customerID, round(churn_probability, 4) AS churn_probability, risk_tier, Contract, MonthlyCharges,
       round(annual_revenue, 2) AS annual_revenue, lifetime_months, round(revenue_at_risk, 2) AS revenue_at_risk
FROM pf ORDER BY revenue_at_risk DESC, customerID LIMIT 50
""")
def q_revenue_top50(spark, sf_dir):
    return P.revenue_top(scored_portfolio(spark, sf_dir), 50)


@query("revenue_breakdown", """
SELECT CASE WHEN grouping(risk_tier) = 0 THEN 'risk_tier' ELSE 'Contract' END AS dimension,
       coalesce(risk_tier, Contract) AS value, count(*) AS n,
       round(sum(annual_revenue), 2) AS total_annual_revenue,
       round(sum(revenue_at_risk), 2) AS revenue_at_risk,
       round(avg(churn_probability), 4) AS avg_churn_prob
FROM pf GROUP BY GROUPING SETS ((risk_tier), (Contract))
""")
def q_revenue_breakdown(spark, sf_dir):
    return P.revenue_breakdown(scored_portfolio(spark, sf_dir))


@query("revenue_histogram", """
, vals AS (SELECT revenue_at_risk AS x FROM pf WHERE revenue_at_risk > 0),
mm0 AS (SELECT min(x) AS a, max(x) AS b FROM vals),
mm AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo0, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi0 FROM mm0)
""" + _HIST)
def q_revenue_histogram(spark, sf_dir):
    return P.revenue_histogram(scored_portfolio(spark, sf_dir))


def _strategies(spark):
    return spark.createDataFrame(STRATEGIES, "slot string, name string, cost_per_customer double, effectiveness double")


@query("strategy_comparison", AT_RISK + """
, res AS (SELECT slot, name, cost_per_customer, effectiveness, total_at_risk, n_take AS customers_targeted,
                 round(n_take * cost_per_customer, 2) AS campaign_cost,
                 round(effectiveness * n_take, 4) AS estimated_retained,
                 round(rar_sum * effectiveness, 2) AS revenue_saved,
                 round(rar_sum * effectiveness - n_take * cost_per_customer, 2) AS net_roi,
                 CASE WHEN n_take * cost_per_customer > 0
                      THEN round((rar_sum * effectiveness - n_take * cost_per_customer) / (n_take * cost_per_customer) * 100, 4)
                      ELSE 0.0::DOUBLE END AS roi_pct
          FROM st2)
SELECT res.*, CASE WHEN slot = 'A' THEN a.net_roi > b.net_roi ELSE NOT (a.net_roi > b.net_roi) END AS is_winner
FROM res, (SELECT net_roi FROM res WHERE slot = 'A') a, (SELECT net_roi FROM res WHERE slot = 'B') b
""")
def q_strategy_comparison(spark, sf_dir):
    return P.strategy_comparison(scored_portfolio(spark, sf_dir), _strategies(spark), BUDGET, 0.3)


@query("strategy_breakdown", AT_RISK + """
, tg AS (SELECT st2.slot, ar.* FROM st2 JOIN ar ON ar.rank <= st2.n_take)
SELECT slot, CASE WHEN grouping(risk_tier) = 0 THEN 'risk_tier' ELSE 'Contract' END AS dimension,
       coalesce(risk_tier, Contract) AS value, count(*) AS n
FROM tg GROUP BY GROUPING SETS ((slot, risk_tier), (slot, Contract))
""")
def q_strategy_breakdown(spark, sf_dir):
    return P.strategy_breakdown(scored_portfolio(spark, sf_dir), _strategies(spark), BUDGET, 0.3)


@query("strategy_sensitivity", AT_RISK + """
SELECT CAST(e AS INTEGER) AS effectiveness_pct,
       max(CASE WHEN slot = 'A' THEN round(rar_sum * (e / 100.0) - n_take * cost_per_customer, 2) END) AS strategy_a_roi,
       max(CASE WHEN slot = 'B' THEN round(rar_sum * (e / 100.0) - n_take * cost_per_customer, 2) END) AS strategy_b_roi
FROM range(10, 55, 5) g(e), st2 GROUP BY e
""")
def q_strategy_sensitivity(spark, sf_dir):
    return P.strategy_sensitivity(scored_portfolio(spark, sf_dir), _strategies(spark), BUDGET, 0.3)


_INTERVENTIONS_SQL = f"""
, iv AS (
  SELECT customerID, 1 AS o, '{C.INTERVENTION_CONTRACT[0]}' AS action, '{C.INTERVENTION_CONTRACT[1]}' AS category,
         '{C.INTERVENTION_CONTRACT[2]}' AS priority, 0.0::DOUBLE AS estimated_cost, '{C.INTERVENTION_CONTRACT[4]}' AS description
  FROM pf WHERE Contract = 'Month-to-month'
  UNION ALL
  SELECT customerID, 2, '{C.INTERVENTION_SUPPORT[0]}', '{C.INTERVENTION_SUPPORT[1]}', '{C.INTERVENTION_SUPPORT[2]}',
         30.0::DOUBLE, '{C.INTERVENTION_SUPPORT[4]}'
  FROM pf WHERE TechSupport = 'No' AND InternetService IS DISTINCT FROM 'No'
  UNION ALL
  SELECT customerID, 3, '{C.INTERVENTION_SECURITY[0]}', '{C.INTERVENTION_SECURITY[1]}', '{C.INTERVENTION_SECURITY[2]}',
         20.0::DOUBLE, '{C.INTERVENTION_SECURITY[4]}'
  FROM pf WHERE OnlineSecurity = 'No' AND InternetService IS DISTINCT FROM 'No'
  UNION ALL
  SELECT customerID, 4, '{C.INTERVENTION_AUTOPAY[0]}', '{C.INTERVENTION_AUTOPAY[1]}', '{C.INTERVENTION_AUTOPAY[2]}',
         0.0::DOUBLE, '{C.INTERVENTION_AUTOPAY[4]}'
  FROM pf WHERE PaymentMethod = 'Electronic check'
  UNION ALL
  SELECT customerID, 5, '{C.INTERVENTION_DISCOUNT_ACTION}', '{C.INTERVENTION_DISCOUNT_CATEGORY}',
         CASE WHEN churn_probability > 0.6 THEN 'high' ELSE 'medium' END, MonthlyCharges * 0.12,
         'Monthly charges ($' || CAST(CAST(round_even(MonthlyCharges, 0) AS BIGINT) AS VARCHAR)
         || ') are above average. A discount may retain this customer.'
  FROM pf WHERE MonthlyCharges > 80.0
)
"""


@query("customer_interventions", _INTERVENTIONS_SQL + """
SELECT customerID, CAST(row_number() OVER (PARTITION BY customerID ORDER BY o) AS INTEGER) AS position,
       action, category, priority, round(estimated_cost, 4) AS estimated_cost, description
FROM iv
""")
def q_customer_interventions(spark, sf_dir):
    return P.customer_interventions(scored_portfolio(spark, sf_dir))


@query("customer_lookup", """
, req AS (SELECT c_name AS customerID FROM customer)
SELECT req.customerID, round(pf.churn_probability, 4) AS churn_probability, pf.risk_tier, pf.predicted_churn,
       pf.Churn, round(pf.annual_revenue, 2) AS annual_revenue, pf.lifetime_months,
       round(pf.revenue_at_risk, 2) AS revenue_at_risk, pf.risk_tier IS NOT NULL AS found
FROM req LEFT JOIN pf ON req.customerID = pf.customerID
""")
def q_customer_lookup(spark, sf_dir):
    from retainlab.sources.tables import read_table

    req = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias(C.ID_COL))
    return P.customer_lookup(scored_portfolio(spark, sf_dir), req)


@query("customer_search", f"""
SELECT customerID, round(churn_probability, 4) AS churn_probability, risk_tier, MonthlyCharges, Contract
FROM portfolio WHERE regexp_matches(customerID, '{SEARCH_PATTERN}', 'i')
ORDER BY customerID LIMIT 10
""")
def q_customer_search(spark, sf_dir):
    return P.customer_search(scored_portfolio(spark, sf_dir), SEARCH_PATTERN, 10)


@query("watch_list", f"""
, w AS (SELECT * FROM pf WHERE churn_probability >= 0.6),
top AS (SELECT * FROM w ORDER BY revenue_at_risk DESC, customerID LIMIT 50)
SELECT customerID, round(churn_probability, 4) AS churn_probability, risk_tier, Contract, MonthlyCharges, tenure,
       round(revenue_at_risk, 2) AS revenue_at_risk,
       array_to_string(list_filter([CASE WHEN Contract = 'Month-to-month' THEN '{C.QUICK_ACTIONS[0]}' END,
                    CASE WHEN TechSupport = 'No' AND InternetService IS DISTINCT FROM 'No' THEN '{C.QUICK_ACTIONS[1]}' END,
                    CASE WHEN PaymentMethod = 'Electronic check' THEN '{C.QUICK_ACTIONS[2]}' END], lambda x: x IS NOT NULL), '|')
         AS quick_actions,
       (SELECT count(*) FROM w) AS total, 0.6::DOUBLE AS threshold
FROM top
""")
def q_watch_list(spark, sf_dir):
    return P.watch_list(scored_portfolio(spark, sf_dir), 0.6, "revenue_at_risk", 50)


@query("segment_analysis", f"""
, s AS (SELECT * FROM pf WHERE {SEG_WHERE})
SELECT count(*) AS segment_size, round(count(*) / (SELECT count(*) FROM pf) * 100, 4) AS pct_of_total,
       round(avg(churn_probability), 4) AS avg_churn_probability,
       round(quantile_cont(churn_probability, 0.5), 4) AS median_churn_probability,
       count_if(risk_tier = 'high') AS high_risk_count,
       round(avg(MonthlyCharges), 2) AS avg_monthly_charges,
       round(avg(tenure), 4) AS avg_tenure,
       round(sum(revenue_at_risk), 2) AS total_revenue_at_risk,
       round(avg(revenue_at_risk), 2) AS avg_revenue_at_risk
FROM s
""")
def q_segment_analysis(spark, sf_dir):
    return P.segment_analysis(scored_portfolio(spark, sf_dir), SEGMENT)


@query("segment_profile", f"""
, s AS (SELECT * FROM pf WHERE {SEG_WHERE})
SELECT CASE WHEN grouping(Contract) = 0 THEN 'Contract' WHEN grouping(InternetService) = 0 THEN 'InternetService'
            WHEN grouping(PaymentMethod) = 0 THEN 'PaymentMethod' WHEN grouping(TechSupport) = 0 THEN 'TechSupport'
            WHEN grouping(OnlineSecurity) = 0 THEN 'OnlineSecurity' ELSE 'risk_tier' END AS dimension,
       coalesce(Contract, InternetService, PaymentMethod, TechSupport, OnlineSecurity, risk_tier) AS value,
       count(*) AS n
FROM s GROUP BY GROUPING SETS ((Contract), (InternetService), (PaymentMethod), (TechSupport), (OnlineSecurity), (risk_tier))
""")
def q_segment_profile(spark, sf_dir):
    return P.segment_profile(scored_portfolio(spark, sf_dir), SEGMENT)


@query("executive_summary", """
SELECT count(*) AS total_customers,
       round(avg(CASE WHEN Churn = 'Yes' THEN 1.0::DOUBLE WHEN Churn = 'No' THEN 0.0::DOUBLE END), 4) AS churn_rate,
       count_if(risk_tier = 'high') AS high_risk_count, count_if(risk_tier = 'medium') AS medium_risk_count,
       round(sum(revenue_at_risk), 2) AS total_revenue_at_risk,
       round(sum(MonthlyCharges) * 12, 2) AS total_annual_revenue,
       round(avg(churn_probability), 4) AS avg_churn_probability,
       'm1' AS model_name,
       (SELECT round(CAST(2 * count_if(p.score > n.score) + count_if(p.score = n.score) AS DOUBLE)
                     / (CAST(count(DISTINCT p.k) AS DOUBLE) * CAST(count(DISTINCT n.k) AS DOUBLE) * 2.0), 6)
        FROM scores_long p JOIN scores_long n ON p.model = 'm1' AND n.model = 'm1' AND p.split = 'test'
             AND n.split = 'test' AND p.y_true = 1 AND n.y_true = 0) AS model_auc
FROM pf
""")
def q_executive_summary(spark, sf_dir):
    """Executive summary; the serving model is scorer m1 with its test ROC-AUC."""
    from retainlab.operators.evaluate import roc_auc
    from retainlab.sources.fixtures import scores_long

    auc = roc_auc(scores_long(spark, sf_dir, "test").filter(F.col("model") == "m1"))
    model = auc.select(F.col("model").alias("model_name"), F.col("roc_auc").alias("model_auc"))
    return P.executive_summary(scored_portfolio(spark, sf_dir), model)


@query("priority_actions", f"""
, a AS (
  SELECT {C.PRIORITY_ACTIONS[0][0]} AS priority, '{C.PRIORITY_ACTIONS[0][1]}' AS action,
         count_if(Contract = 'Month-to-month' AND risk_tier = 'high') AS affected_customers,
         round(coalesce(sum(CASE WHEN Contract = 'Month-to-month' AND risk_tier = 'high' THEN revenue_at_risk END), 0.0), 2) AS revenue_at_risk,
         '{C.PRIORITY_ACTIONS[0][2]}' AS category FROM pf
  UNION ALL
  SELECT {C.PRIORITY_ACTIONS[1][0]}, '{C.PRIORITY_ACTIONS[1][1]}',
         count_if(TechSupport = 'No' AND InternetService IS DISTINCT FROM 'No' AND churn_probability > 0.5),
         round(coalesce(sum(CASE WHEN TechSupport = 'No' AND InternetService IS DISTINCT FROM 'No' AND churn_probability > 0.5 THEN revenue_at_risk END), 0.0), 2),
         '{C.PRIORITY_ACTIONS[1][2]}' FROM pf
  UNION ALL
  SELECT {C.PRIORITY_ACTIONS[2][0]}, '{C.PRIORITY_ACTIONS[2][1]}',
         count_if(PaymentMethod = 'Electronic check' AND churn_probability > 0.4),
         round(coalesce(sum(CASE WHEN PaymentMethod = 'Electronic check' AND churn_probability > 0.4 THEN revenue_at_risk END), 0.0), 2),
         '{C.PRIORITY_ACTIONS[2][2]}' FROM pf
)
SELECT * FROM a WHERE affected_customers > 0
""")
def q_priority_actions(spark, sf_dir):
    return P.priority_actions(scored_portfolio(spark, sf_dir))


@query("risk_by_contract", """
SELECT Contract, count(*) AS count, round(avg(churn_probability), 4) AS avg_churn,
       count_if(risk_tier = 'high') AS high_risk
FROM portfolio GROUP BY Contract
""")
def q_risk_by_contract(spark, sf_dir):
    return P.risk_by_contract(scored_portfolio(spark, sf_dir))
