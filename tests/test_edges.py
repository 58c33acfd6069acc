"""Edge cases (FIXTURES section 6) and round trips."""

import pytest
from pyspark.sql import functions as F

from retainlab.functions import rules as R
from retainlab.functions.features import engineer_features
from retainlab.operators import calibrate as CA
from retainlab.operators import evaluate as E
from retainlab.operators import portfolio as P


def test_tier_and_level_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,)], "p double")
    r = df.select("p", R.risk_tier(F.col("p")).alias("t"), R.risk_level(F.col("p")).alias("l")).collect()
    assert [(x.t, x.l) for x in r] == [("low", "low"), ("low", "medium"), ("medium", "high"), ("high", "high")]


def test_ece_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.6,), (1.0,)], "p double")
    r = [x[0] for x in df.select(CA.ece_bin(F.col("p"))).collect()]
    assert r == [None, 1, 3, 6, 10]
    r = [x[0] for x in df.select(CA.reliability_bin(F.col("p"))).collect()]
    assert r == [0, 0, 2, 5, 9]


def test_tenure_bins(spark):
    df = spark.createDataFrame([(t, 10.0, 10.0) for t in (0, 6, 12, 24, 48, 72, 73)],
                               "tenure int, MonthlyCharges double, TotalCharges double")
    r = engineer_features(df).select("tenure", "tenure_bin", "IsNewCustomer").collect()
    assert [x.tenure_bin for x in r] == [None, "0-12", "0-12", "13-24", "25-48", "49-72", "73+"]
    assert [x.IsNewCustomer for x in r] == [1, 1, 0, 0, 0, 0, 0]


def test_one_class_split_auc_is_null(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.9)], "model string, y_true int, score double")
    assert E.roc_auc(df).first()["roc_auc"] is None


def _pf(spark, rows):
    schema = ("k long, customerID string, churn_probability double, Contract string, MonthlyCharges double, "
              "tenure int, TechSupport string, InternetService string, OnlineSecurity string, "
              "PaymentMethod string, Churn string, SeniorCitizen int, Partner string")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"risk_tier": R.risk_tier(F.col("churn_probability")),
                           "predicted_churn": (F.col("churn_probability") >= 0.5).cast("int"),
                           "lifetime_months": R.lifetime_months(F.col("Contract"))})


ROWS = [
    (1, "a", 0.9, "Month-to-month", 90.0, 3, "No", "Fiber optic", "No", "Electronic check", "Yes", 0, "No"),
    (2, "b", 0.5, "Three year", 50.0, 30, "Yes", "DSL", "Yes", "Mailed check", "No", 1, "Yes"),
]


def test_unknown_contract_lifetime(spark):
    r = {x.customerID: x.lifetime_months for x in _pf(spark, ROWS).collect()}
    assert r == {"a": 6, "b": 12}


def test_budget_below_one_offer(spark):
    out = P.campaign_summary(_pf(spark, ROWS), budget=10.0, offer_cost=50.0).first()
    assert out["customers_targeted"] == 0 and out["roi_pct"] == 0.0


def test_empty_segment(spark):
    out = P.segment_analysis(_pf(spark, ROWS), {"contract": "Two year"}).first()
    assert out["segment_size"] == 0


def test_equal_roi_goes_to_b(spark):
    st = spark.createDataFrame([("A", "x", 50.0, 0.3), ("B", "y", 50.0, 0.3)],
                               "slot string, name string, cost_per_customer double, effectiveness double")
    r = {x.slot: x.is_winner for x in P.strategy_comparison(_pf(spark, ROWS), st, 1000.0, 0.0).collect()}
    assert r == {"A": False, "B": True}


def test_interventions_null_internet_counts_as_not_no(spark):
    rows = [ROWS[0][:7] + (None,) + ROWS[0][8:]]
    x = P.customer_interventions(_pf(spark, rows)).collect()
    assert "Add free Tech Support (3 months)" in {r.action for r in x}


def test_unseen_category_zero_vector(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from retainlab.operators.prepare import fit_preprocessor

    tr = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, x double")
    prep = fit_preprocessor(tr)
    test = spark.createDataFrame([("z", 2.0), (None, None)], "c string, x double")
    out = [list(r[0]) for r in prep.model.transform(test).select(vector_to_array("features")).collect()]
    assert out[0][1:] == [0.0, 0.0]          # unseen category -> all zeros
    assert out[1][1:] == [1.0, 0.0]          # missing -> mode 'a'
    path = str(tmp_path / "prep")
    prep.model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(test).select(vector_to_array("features")).collect()
    assert [list(r[0]) for r in again] == out


def test_metric_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, 3)], "model string, f1 double, n long")
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        df.write.mode("overwrite").format(fmt).option("header", True).save(path)
        back = spark.read.schema(df.schema).format(fmt).option("header", True).load(path)
        assert back.collect() == df.collect()


def test_keyset_page_equals_offset_page(spark):
    from retainlab.plans.q_portfolio import scored_portfolio

    from .conftest import SMALL

    pf = scored_portfolio(spark, SMALL)
    p1 = P.customer_page(pf, page=1, per_page=7, sort_by="MonthlyCharges").collect()
    p2 = P.customer_page(pf, page=2, per_page=7, sort_by="MonthlyCharges").collect()
    last = p1[-1]
    k2 = P.customer_page(pf, per_page=7, sort_by="MonthlyCharges",
                         after=(last["MonthlyCharges"], last["customerID"])).collect()
    assert [r["customerID"] for r in k2] == [r["customerID"] for r in p2]


def test_knn_vote_zero_distance_takes_all_weight(spark):
    from retainlab.operators.neighbours import knn_vote

    nb = spark.createDataFrame([(1, 10, 0.0), (1, 11, 0.5), (1, 12, 1.0)], "qid long, rid long, dist double")
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, 0)], "vec_id long, y_true int")
    assert knn_vote(nb, labels).first()["score"] == 1.0


def test_knora_u_all_zero_hits_falls_back_to_mean(spark):
    from retainlab.operators.neighbours import knora_u

    comp = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 0, 0)], "qid long, model string, hits int, prefix int")
    qs = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.6)], "vec_id long, model string, score double")
    assert knora_u(comp, qs).first()["score"] == pytest.approx(0.4)
