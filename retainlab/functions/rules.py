"""Business rules of the scored portfolio as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retainlab import config as C


def risk_tier(p: Column) -> Column:
    """Right-closed tiers [0,0.3] (0.3,0.6] (0.6,1]."""
    lo, mid = C.TIER_EDGES
    return F.when(p <= lo, C.TIERS[0]).when(p <= mid, C.TIERS[1]).when(p.isNotNull(), C.TIERS[2])


def risk_level(p: Column) -> Column:
    """Left-closed levels p < 0.3, p < 0.6 (differs from the tier at the edges)."""
    lo, mid = C.TIER_EDGES
    return F.when(p < lo, C.TIERS[0]).when(p < mid, C.TIERS[1]).when(p.isNotNull(), C.TIERS[2])


def recommendation(p: Column) -> Column:
    lo, mid = C.TIER_EDGES
    return (
        F.when(p < lo, C.RECOMMENDATION_LOW)
        .when(p < mid, C.RECOMMENDATION_MEDIUM)
        .when(p.isNotNull(), C.RECOMMENDATION_HIGH)
    )


def lifetime_months(contract: Column) -> Column:
    expr = None
    for name, months in C.LIFETIME_MONTHS.items():
        expr = F.when(contract == name, months) if expr is None else expr.when(contract == name, months)
    return expr.otherwise(C.LIFETIME_DEFAULT).cast("int")


def revenue_at_risk(p: Column, monthly: Column, lifetime: Column) -> Column:
    return p * monthly * lifetime


def not_equal_nullsafe(c: Column, value: str) -> Column:
    """pandas ``!=``: a missing value is unequal to everything."""
    return ~c.eqNullSafe(value)


def needs_support(df_cols=None) -> Column:
    return F.col("TechSupport").eqNullSafe("No") & not_equal_nullsafe(F.col("InternetService"), "No")


def needs_security() -> Column:
    return F.col("OnlineSecurity").eqNullSafe("No") & not_equal_nullsafe(F.col("InternetService"), "No")


def round_half_even_int(x: Column) -> Column:
    """Python's ``format(x, '.0f')``: half to even on the exact binary value."""
    return F.bround(x, 0).cast("bigint")
