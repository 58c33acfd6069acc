"""Golden values from the modelled project's published confusion matrix:
839 TN, 195 FP, 95 FN, 276 TP."""

import pytest

from retainlab.operators import evaluate as E


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([("stack", 276, 195, 95, 839)], "model string, tp long, fp long, fn long, tn long")


def test_binary_metrics(counts):
    r = E.with_metrics(counts).first()
    assert r["accuracy"] == pytest.approx(0.793594, abs=1e-6)
    assert r["precision"] == pytest.approx(0.585987, abs=1e-6)
    assert r["recall"] == pytest.approx(0.743935, abs=1e-6)
    assert r["f1"] == pytest.approx(0.655582, abs=1e-6)


def test_class_report(counts):
    rep = {r["label"]: r for r in E.class_report(counts).collect()}
    assert rep["0"]["precision"] == pytest.approx(0.898287, abs=1e-6)
    assert rep["0"]["recall"] == pytest.approx(0.811412, abs=1e-6)
    assert rep["0"]["f1"] == pytest.approx(0.852642, abs=1e-6)
    assert rep["0"]["support"] == 1034 and rep["1"]["support"] == 371
    assert rep["macro avg"]["f1"] == pytest.approx(0.754112, abs=1e-6)
    assert rep["weighted avg"]["precision"] == pytest.approx(0.815822, abs=1e-6)
    assert rep["weighted avg"]["f1"] == pytest.approx(0.800607, abs=1e-6)


def test_feature_names_width(spark):
    from retainlab.plans.q_prepare import prepared_vectors

    from .conftest import SMALL

    v, prep = prepared_vectors(spark, SMALL)
    assert len(prep.names) == 57
    assert prep.names[:4] == ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
    assert prep.names[-1] == "tenure_bin_49-72"
    assert v.select("features").first()[0].size == 57
