"""Preparation queries P1-P11."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.functions.features import engineer_features
from retainlab.operators import clean as CL
from retainlab.operators import prepare as PR
from retainlab.plans.registry import query
from retainlab.sources.fixtures import profile_split, split_hash

NUMERIC = [
    "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlyCharge", "ChargeIncrease",
    "MonthlyToTotalRatio", "IsNewCustomer", "NumServices", "HasSecurity", "HasSupport", "AutoPay",
]
CATEGORICAL = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", *C.SERVICE_COLUMNS,
    "Contract", "PaperlessBilling", "PaymentMethod", "tenure_bin",
]


def prepared_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed, split, coerced, target-mapped, de-duplicated rows with
    engineered features (the modelled load step: duplicates over all columns
    but the id are dropped before the split; the smallest key survives)."""
    p = CL.coerce_numeric(profile_split(spark, sf_dir))
    p = p.withColumn("y_true", CL.target_expr()).drop(C.TARGET_COL, "risk_pts", "m_cents")
    p = p.filter(F.col("y_true").isNotNull())
    survivors = p.groupBy(*C.FEATURE_COLUMNS, "y_true").agg(F.min("k").alias("k")).select("k")
    p = p.join(survivors, "k", "left_semi")
    return engineer_features(p)


# ------------------------------------------------------------------ SQL
_YES = "CAST(coalesce({c} = 'Yes', false) AS INTEGER)"
FX_SQL = f"""
, c00 AS (SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM ps),
dd AS (SELECT min(k) AS k FROM c00 GROUP BY {", ".join(C.FEATURE_COLUMNS)}, y_true),
c0 AS (SELECT * FROM c00 SEMI JOIN dd USING (k)),
fx AS (
  SELECT customerID, k, split, y_true, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService,
    MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
    StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges,
    TotalCharges / greatest(tenure, 1) AS AvgMonthlyCharge,
    MonthlyCharges - TotalCharges / greatest(tenure, 1) AS ChargeIncrease,
    CASE WHEN TotalCharges IS NULL THEN NULL ELSE MonthlyCharges / greatest(TotalCharges, 1) END AS MonthlyToTotalRatio,
    CASE WHEN tenure > 0 AND tenure <= 12 THEN '0-12' WHEN tenure > 12 AND tenure <= 24 THEN '13-24'
         WHEN tenure > 24 AND tenure <= 48 THEN '25-48' WHEN tenure > 48 AND tenure <= 72 THEN '49-72'
         WHEN tenure > 72 THEN '73+' END AS tenure_bin,
    CAST(CASE WHEN tenure <= 6 THEN 1 ELSE 0 END AS INTEGER) AS IsNewCustomer,
    CAST({' + '.join(_YES.format(c=c) for c in C.SERVICE_COLUMNS)} AS INTEGER) AS NumServices,
    {_YES.format(c='OnlineSecurity')} AS HasSecurity, {_YES.format(c='TechSupport')} AS HasSupport,
    CAST(coalesce(contains(lower(PaymentMethod), 'automatic'), false) AS INTEGER) AS AutoPay
  FROM c0),
tr AS (SELECT * FROM fx WHERE split = 'train')
"""
MED_SQL = ", med AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM tr" for c in NUMERIC
) + ")"
NUM_LONG_ALL = " UNION ALL ".join(
    f"SELECT customerID, split, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM fx" for c in NUMERIC
)
IMPUTED_SQL = MED_SQL + f"""
, nl AS ({NUM_LONG_ALL}),
imp AS (SELECT nl.customerID, nl.split, nl.feature, coalesce(nl.value, med.median) AS value
        FROM nl JOIN med USING (feature)),
mo AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi
       FROM imp WHERE split = 'train' GROUP BY feature)
"""
CAT_LONG_TRAIN = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM tr" for c in CATEGORICAL
)
CAT_LONG_ALL = " UNION ALL ".join(
    f"SELECT customerID, '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {i} AS ci FROM fx"
    for i, c in enumerate(CATEGORICAL)
)
MODE_SQL = f"""
, cl AS ({CAT_LONG_TRAIN}),
cc AS (SELECT feature, value, count(*) AS n FROM cl WHERE value IS NOT NULL GROUP BY feature, value),
mode AS (SELECT feature, value AS mode FROM
           (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r FROM cc) t WHERE r = 1)
"""
CATS_SQL = MODE_SQL + f"""
, call AS (SELECT a.customerID, a.feature, a.ci, coalesce(a.value, m.mode) AS value
           FROM ({CAT_LONG_ALL}) a LEFT JOIN mode m USING (feature)),
ctr AS (SELECT DISTINCT c.feature, c.ci, c.value FROM call c JOIN fx ON fx.customerID = c.customerID
        WHERE fx.split = 'train' AND c.value IS NOT NULL)
"""


@query("hash_split", "SELECT customerID, split FROM ps")
def q_hash_split(spark, sf_dir):
    return profile_split(spark, sf_dir).select(C.ID_COL, "split")


@query("exact_stratified_split", FX_SQL + """
, h AS (SELECT customerID, k, y_true, CAST(('0x' || substr(md5(CAST(k AS VARCHAR) || '|42'), 1, 8)) AS BIGINT)
                                        / 4294967296.0 AS h FROM c0),
r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY h, k) AS r,
             count(*) OVER (PARTITION BY y_true) AS n FROM h)
SELECT customerID, y_true,
       CASE WHEN (r - 1) * 10 < n * 7 THEN 'train' WHEN (r - 1) * 10 < n * 8 THEN 'val' ELSE 'test' END AS split
FROM r
""")
def q_exact_stratified_split(spark, sf_dir):
    p = prepared_input(spark, sf_dir).select(C.ID_COL, "k", "y_true").withColumn("h", split_hash(F.col("k")))
    return PR.stratified_exact_split(p, "h", "k").select(C.ID_COL, "y_true", "split")


@query("impute_median", FX_SQL + MED_SQL + " SELECT feature, round(median, 6) AS median FROM med")
def q_impute_median(spark, sf_dir):
    tr = prepared_input(spark, sf_dir).filter(F.col("split") == "train")
    return PR.medians(tr, NUMERIC).select("feature", F.round("median", 6).alias("median"))


@query("impute_mode", FX_SQL + MODE_SQL + " SELECT feature, mode FROM mode")
def q_impute_mode(spark, sf_dir):
    tr = prepared_input(spark, sf_dir).filter(F.col("split") == "train")
    return PR.modes(tr, CATEGORICAL)


def _scaled(spark, sf_dir, kind):
    x = prepared_input(spark, sf_dir)
    tr = x.filter(F.col("split") == "train")
    med = {r["feature"]: r["median"] for r in PR.medians(tr, NUMERIC).collect()}
    xi = PR.impute_numeric(x, med)
    stats = {r["feature"]: r for r in PR.moments(xi.filter(F.col("split") == "train"), NUMERIC).collect()}
    if kind == "standard":
        exprs = {c: PR.standard_expr(c, stats[c]["mean"], stats[c]["std"]) for c in NUMERIC}
    else:
        exprs = {c: PR.minmax_expr(c, stats[c]["min"], stats[c]["max"]) for c in NUMERIC}
    out = PR.melt(xi.withColumns(exprs), NUMERIC, id_cols=(C.ID_COL,), cast="double")
    return out.select(C.ID_COL, "feature", F.round("value", 6).alias("value"))


@query("scale_standard", FX_SQL + IMPUTED_SQL + """
SELECT customerID, feature,
       round((value - mean) / CASE WHEN std > 0 THEN std ELSE 1.0 END, 6) AS value
FROM imp JOIN mo USING (feature)
""")
def q_scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("scale_minmax", FX_SQL + IMPUTED_SQL + """
SELECT customerID, feature,
       round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 6) AS value
FROM imp JOIN mo USING (feature)
""")
def q_scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("onehot_long", FX_SQL + CATS_SQL + """
SELECT c.customerID, c.feature || '_' || c.value AS name, CAST(1 AS INTEGER) AS value
FROM call c SEMI JOIN ctr t ON c.feature = t.feature AND c.value = t.value
""")
def q_onehot_long(spark, sf_dir):
    x = prepared_input(spark, sf_dir)
    tr = x.filter(F.col("split") == "train")
    mode_map = {r["feature"]: r["mode"] for r in PR.modes(tr, CATEGORICAL).collect()}
    cats = PR.categories(tr, CATEGORICAL, mode_map)
    filled = x.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(mode_map.get(c))) for c in CATEGORICAL})
    long = PR.melt(filled, CATEGORICAL, cast="string")
    seen = long.join(cats, ["feature", "value"], "left_semi")
    return seen.select(C.ID_COL, F.concat(F.col("feature"), F.lit("_"), F.col("value")).alias("name"),
                       F.lit(1).alias("value"))


@query("feature_names", FX_SQL + CATS_SQL + f"""
SELECT CAST(i AS INTEGER) AS position, name FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(NUMERIC))}) v(i, name)
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY ci, value) - 1 + {len(NUMERIC)} AS INTEGER), feature || '_' || value FROM ctr
""")
def q_feature_names(spark, sf_dir):
    x = prepared_input(spark, sf_dir)
    tr = x.filter(F.col("split") == "train")
    mode_map = {r["feature"]: r["mode"] for r in PR.modes(tr, CATEGORICAL).collect()}
    cats = PR.categories(tr, CATEGORICAL, mode_map)
    return PR.feature_names(NUMERIC, cats, CATEGORICAL)


@query("class_weights", """
, c AS (SELECT y_true, count(*) AS n FROM ps WHERE split = 'train' GROUP BY y_true),
t AS (SELECT sum(n) AS a, sum(CASE WHEN y_true = 0 THEN n END) AS neg, sum(CASE WHEN y_true = 1 THEN n END) AS pos FROM c)
SELECT y_true, n, round(a / (n * 2.0), 6) AS weight, round(CAST(neg AS DOUBLE) / pos, 6) AS scale_pos_weight FROM c, t
""")
def q_class_weights(spark, sf_dir):
    tr = profile_split(spark, sf_dir).filter(F.col("split") == "train")
    tr = tr.withColumn("y_true", CL.target_expr())
    return PR.class_weights(tr)


def prepared_vectors(spark: SparkSession, sf_dir: str, scale: str | None = "standard") -> tuple[DataFrame, PR.Prepared]:
    x = prepared_input(spark, sf_dir).persist()  # statistics passes and the transform read it
    prep = PR.fit_preprocessor(x.filter(F.col("split") == "train"), scale=scale)
    return prep.model.transform(x), prep


@query("prepared_vectors")
def q_prepared_vectors(spark, sf_dir):
    v, prep = prepared_vectors(spark, sf_dir)
    arr = vector_to_array("features")
    return v.select(C.ID_COL, "split", "y_true", F.size(arr).alias("n_features"), arr.alias("features"))


@query("smote_rows")
def q_smote_rows(spark, sf_dir):
    """Synthetic minority rows for the train split (n_major - n_minor rows)."""
    from pyspark.ml.functions import vector_to_array

    v, prep = prepared_vectors(spark, sf_dir)
    tr = v.filter(F.col("split") == "train").select("k", "y_true", vector_to_array("features").alias("vec"))
    return PR.smote(tr)
