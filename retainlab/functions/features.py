"""Engineered features F1-F9 as single-pass column expressions.

Each rule is added only when its input columns exist (a plan-time check on
``df.columns``), like the modelled feature step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.config import SERVICE_COLUMNS, TENURE_BINS, TENURE_OPEN_LABEL


def is_yes(c: str) -> Column:
    """1 when the text equals Yes; missing gives 0 (pandas comparison semantics)."""
    return F.col(c).eqNullSafe("Yes").cast("int")


def tenure_bin(tenure: Column) -> Column:
    """Right-closed bins (0,12] (12,24] (24,48] (48,72] (72,inf); 0 and null stay null."""
    expr = None
    for lo, hi, label in TENURE_BINS:
        cond = (tenure > lo) & (tenure <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(tenure > TENURE_BINS[-1][1], TENURE_OPEN_LABEL)


def _clip_low_one(c: Column) -> Column:
    # pandas clip(lower=1) keeps missing values missing; greatest() would not
    return F.when(c.isNotNull(), F.greatest(c, F.lit(1)))


def engineer_features(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    exprs: dict[str, Column] = {}
    if {"TotalCharges", "tenure"} <= cols:
        exprs["AvgMonthlyCharge"] = F.col("TotalCharges") / _clip_low_one(F.col("tenure"))
    if "MonthlyCharges" in cols and ("AvgMonthlyCharge" in exprs or "AvgMonthlyCharge" in cols):
        avg = exprs.get("AvgMonthlyCharge", F.col("AvgMonthlyCharge"))
        exprs["ChargeIncrease"] = F.col("MonthlyCharges") - avg
    if {"MonthlyCharges", "TotalCharges"} <= cols:
        exprs["MonthlyToTotalRatio"] = F.col("MonthlyCharges") / _clip_low_one(F.col("TotalCharges"))
    if "tenure" in cols:
        exprs["tenure_bin"] = tenure_bin(F.col("tenure"))
        exprs["IsNewCustomer"] = F.coalesce((F.col("tenure") <= 6).cast("int"), F.lit(0))
    present = [c for c in SERVICE_COLUMNS if c in cols]
    if present:
        total = is_yes(present[0])
        for c in present[1:]:
            total = total + is_yes(c)
        exprs["NumServices"] = total.cast("int")
    if "OnlineSecurity" in cols:
        exprs["HasSecurity"] = is_yes("OnlineSecurity")
    if "TechSupport" in cols:
        exprs["HasSupport"] = is_yes("TechSupport")
    if "PaymentMethod" in cols:
        exprs["AutoPay"] = F.coalesce(
            F.lower(F.col("PaymentMethod")).contains("automatic").cast("int"), F.lit(0)
        )
    return df.withColumns(exprs)


ENGINEERED_NUMERIC = (
    "AvgMonthlyCharge",
    "ChargeIncrease",
    "MonthlyToTotalRatio",
    "IsNewCustomer",
    "NumServices",
    "HasSecurity",
    "HasSupport",
    "AutoPay",
)
