"""Source, cleaning and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.functions.features import engineer_features
from retainlab.operators import clean as CL
from retainlab.plans.registry import query
from retainlab.sources.fixtures import profile, profile_dirty

PROFILE_COLS = (
    "customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines, "
    "InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, "
    "StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn"
)
FEATURE_ONLY = PROFILE_COLS.replace("customerID, ", "").replace(", Churn", "")
TARGET_SQL = "CAST(CASE WHEN trim(Churn) IN ('Yes', '1') THEN 1 WHEN trim(Churn) IN ('No', '0') THEN 0 END AS INTEGER)"

ENGINEERED_OUT = (
    "AvgMonthlyCharge", "ChargeIncrease", "MonthlyToTotalRatio", "tenure_bin", "IsNewCustomer",
    "NumServices", "HasSecurity", "HasSupport", "AutoPay",
)


def features_sql(src: str) -> str:
    """DuckDB form of the engineered features on a coerced source."""
    yes = "CAST(coalesce({c} = 'Yes', false) AS INTEGER)"
    services = " + ".join(yes.format(c=c) for c in C.SERVICE_COLUMNS)
    return f"""
    SELECT customerID,
      round(TotalCharges / greatest(tenure, 1), 6) AS AvgMonthlyCharge,
      round(MonthlyCharges - TotalCharges / greatest(tenure, 1), 6) AS ChargeIncrease,
      round(CASE WHEN TotalCharges IS NULL THEN NULL ELSE MonthlyCharges / greatest(TotalCharges, 1) END, 6)
        AS MonthlyToTotalRatio,
      CASE WHEN tenure > 0 AND tenure <= 12 THEN '0-12' WHEN tenure > 12 AND tenure <= 24 THEN '13-24'
           WHEN tenure > 24 AND tenure <= 48 THEN '25-48' WHEN tenure > 48 AND tenure <= 72 THEN '49-72'
           WHEN tenure > 72 THEN '73+' END AS tenure_bin,
      CAST(CASE WHEN tenure <= 6 THEN 1 ELSE 0 END AS INTEGER) AS IsNewCustomer,
      CAST({services} AS INTEGER) AS NumServices,
      {yes.format(c='OnlineSecurity')} AS HasSecurity,
      {yes.format(c='TechSupport')} AS HasSupport,
      CAST(coalesce(contains(lower(PaymentMethod), 'automatic'), false) AS INTEGER) AS AutoPay
    FROM {src}"""


def engineered_out(df: DataFrame) -> DataFrame:
    f = engineer_features(df)
    dbl = {"AvgMonthlyCharge", "ChargeIncrease", "MonthlyToTotalRatio"}
    return f.select(C.ID_COL, *[F.round(c, 6).alias(c) if c in dbl else F.col(c) for c in ENGINEERED_OUT])


@query("profile_scan", f"SELECT {PROFILE_COLS} FROM profile")
def q_profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir)


@query("profile_csv_scan", f"SELECT {PROFILE_COLS} FROM profile")
def q_profile_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 as the modelled code does it: the customer table as header CSV,
    read with an explicit schema. The CSV is written from the derived
    profile into the shared checkpoint folder first."""
    import uuid

    from retainlab.session import scratch_path
    from retainlab.sources.io import read_customers_csv, write_csv

    path = scratch_path(spark, f"profile-csv-{uuid.uuid4().hex[:8]}")
    write_csv(profile(spark, sf_dir), path)
    return read_customers_csv(spark, path)


@query("coerce_charges", """
SELECT customerID, TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges FROM profile
""")
def q_coerce_charges(spark, sf_dir):
    return CL.coerce_numeric(profile(spark, sf_dir)).select(C.ID_COL, "TotalCharges")


@query("clean_target", f"""
SELECT customerID, {TARGET_SQL} AS Churn FROM dirty WHERE {TARGET_SQL} IS NOT NULL
""")
def q_clean_target(spark, sf_dir):
    return CL.map_target(profile_dirty(spark, sf_dir)).select(C.ID_COL, C.TARGET_COL)


@query("clean_target_summary", f"""
SELECT count(*) AS rows_in, count_if({TARGET_SQL} IS NOT NULL) AS rows_kept,
       count_if({TARGET_SQL} IS NULL) AS rows_dropped, count_if({TARGET_SQL} = 1) AS positives
FROM dirty
""")
def q_clean_target_summary(spark, sf_dir):
    return CL.target_summary(profile_dirty(spark, sf_dir))


@query("dedupe_profiles", f"""
, c AS (SELECT customerID, {FEATURE_ONLY.replace('TotalCharges', 'TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges')},
               {TARGET_SQL} AS Churn FROM dirty)
SELECT min(customerID) AS customerID, {FEATURE_ONLY}, Churn FROM c WHERE Churn IS NOT NULL
GROUP BY {FEATURE_ONLY}, Churn
""")
def q_dedupe_profiles(spark, sf_dir):
    d = CL.map_target(CL.coerce_numeric(profile_dirty(spark, sf_dir).drop("k")))
    return CL.drop_duplicates_except_id(d)


@query("portfolio_rows", """
SELECT customerID, TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges FROM profile
WHERE TRY_CAST(trim(TotalCharges) AS DOUBLE) IS NOT NULL
""")
def q_portfolio_rows(spark, sf_dir):
    p = CL.drop_missing(CL.coerce_numeric(profile(spark, sf_dir)))
    return p.select(C.ID_COL, "TotalCharges")


def _validation_sql() -> str:
    checks = [f"CASE WHEN {c} IS NULL THEN '{c}: missing' END" for c in C.FEATURE_COLUMNS]
    checks += [
        "CASE WHEN SeniorCitizen < 0 THEN 'SeniorCitizen: below 0' END",
        "CASE WHEN SeniorCitizen > 1 THEN 'SeniorCitizen: above 1' END",
        "CASE WHEN tenure < 0 THEN 'tenure: below 0' END",
        "CASE WHEN MonthlyCharges < 0.0 THEN 'MonthlyCharges: below 0.0' END",
        "CASE WHEN TotalCharges < 0.0 THEN 'TotalCharges: below 0.0' END",
    ]
    return ", ".join(checks)


@query("validate_profiles", f"""
, c AS (SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM dirty),
v AS (SELECT customerID, list_filter([{_validation_sql()}], lambda x: x IS NOT NULL) AS e FROM c)
SELECT customerID, len(e) = 0 AS is_valid, array_to_string(e, '; ') AS errors FROM v
""")
def q_validate_profiles(spark, sf_dir):
    d = CL.coerce_numeric(profile_dirty(spark, sf_dir).drop("k"))
    v = CL.validate(d)
    return v.select(C.ID_COL, "is_valid", F.array_join("errors", "; ").alias("errors"))


@query("engineer_features", features_sql(
    "(SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM profile) p"))
def q_engineer_features(spark, sf_dir):
    return engineered_out(CL.coerce_numeric(profile(spark, sf_dir)))


@query("null_feature_rules", features_sql(
    "(SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM dirty) p"))
def q_null_feature_rules(spark, sf_dir):
    return engineered_out(CL.coerce_numeric(profile_dirty(spark, sf_dir).drop("k")))
