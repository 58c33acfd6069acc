"""Readers and sinks.

S1: the customer table as header CSV with an explicit schema (no inference;
blank text such as a missing total charge is kept as text for S3).
S8: metric tables to parquet / CSV / JSON. S9: MLlib writers handle models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from retainlab.config import FEATURE_COLUMNS, ID_COL, TARGET_COL

_INTS = {"SeniorCitizen", "tenure"}
_DOUBLES = {"MonthlyCharges"}

PROFILE_SCHEMA = T.StructType(
    [T.StructField(ID_COL, T.StringType())]
    + [
        T.StructField(c, T.IntegerType() if c in _INTS else T.DoubleType() if c in _DOUBLES else T.StringType())
        for c in FEATURE_COLUMNS
    ]
    + [T.StructField(TARGET_COL, T.StringType())]
)

# keep blanks as written: no trimming on either side, empty fields stay empty
_CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_customers_csv(spark: SparkSession, path: str, schema: T.StructType = PROFILE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Metric tables: parquet, csv (with header) or json."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.options(**_CSV)
    w.save(path)
