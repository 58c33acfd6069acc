"""Cleaning operators S2-S7: coercion, target mapping, de-duplication,
missing-value drop and range validation. All are column expressions or one
grouped aggregate; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab import config as C


def coerce_numeric(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    """Text to double; blank or bad text becomes null (ANSI-safe try_cast)."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.expr(f"try_cast(trim(`{col}`) AS DOUBLE)"))


def target_expr(col: str = C.TARGET_COL) -> Column:
    """Yes/No/1/0 to 1/0; anything else null."""
    c = F.trim(F.col(col).cast("string"))
    return F.when(c.isin("Yes", "1"), 1).when(c.isin("No", "0"), 0).cast("int")


def map_target(df: DataFrame, col: str = C.TARGET_COL) -> DataFrame:
    """Map the target and drop unmapped rows; the column must exist."""
    if col not in df.columns:
        raise ValueError(f"Expected '{col}' not found in data")
    return df.withColumn(col, target_expr(col)).filter(F.col(col).isNotNull())


def target_summary(df: DataFrame, col: str = C.TARGET_COL) -> DataFrame:
    """Rows in, kept and dropped by the target mapping, in one aggregate."""
    if col not in df.columns:
        raise ValueError(f"Expected '{col}' not found in data")
    t = target_expr(col)
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(t.isNotNull()).alias("rows_kept"),
        F.count_if(t.isNull()).alias("rows_dropped"),
        F.count_if(t == 1).alias("positives"),
    )


def drop_duplicates_except_id(df: DataFrame, id_col: str = C.ID_COL) -> DataFrame:
    """Rows equal on every column but the id collapse to one; the survivor
    keeps the smallest id so the result is deterministic."""
    keys = [c for c in df.columns if c.lower() != id_col.lower()]
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(id_col, *keys)


def drop_missing(df: DataFrame, cols=("TotalCharges",)) -> DataFrame:
    return df.na.drop(subset=[c for c in cols if c in df.columns])


# ---------------------------------------------------------- S7 validation
RANGES = {
    "SeniorCitizen": (0, 1),
    "tenure": (0, None),
    "MonthlyCharges": (0.0, None),
    "TotalCharges": (0.0, None),
}


def validation_errors(df: DataFrame, required=C.FEATURE_COLUMNS) -> Column:
    """array<string> of rule violations per row (empty when valid)."""
    checks = []
    for c in required:
        if c in df.columns:
            checks.append(F.when(F.col(c).isNull(), F.lit(f"{c}: missing")))
    for c, (lo, hi) in RANGES.items():
        if c not in df.columns:
            continue
        if lo is not None:
            checks.append(F.when(F.col(c) < lo, F.lit(f"{c}: below {lo}")))
        if hi is not None:
            checks.append(F.when(F.col(c) > hi, F.lit(f"{c}: above {hi}")))
    if "threshold" in df.columns:
        checks.append(F.when((F.col("threshold") < 0) | (F.col("threshold") > 1), F.lit("threshold: outside 0..1")))
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", validation_errors(df)).withColumn(
        "is_valid", F.size("errors") == 0
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected tables from one validated plan."""
    v = validate(df)
    return v.filter("is_valid").drop("errors", "is_valid"), v.filter(~F.col("is_valid"))
