"""The model and result store.

A model version is one folder: the preprocessor as MLlib writes it, the trees
as a table of one row per tree, and one JSON row of information (name, start
margin, tuned thresholds, feature names). Versions are written side by side and
``_SUCCESS`` of the information, written last, makes a version complete, so a
version whose write broke off is never loaded. Results are written by tier with
dynamic partition overwrite: writing some tiers again leaves the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlab.operators.boosting import Boosted, score_boosted
from retainlab.operators.hist_trees import Tree
from retainlab.sources.io import write_table

TREES = (
    "tree int, feature array<int>, cut array<int>, threshold array<double>, left array<int>, right array<int>, "
    "value array<double>, cover array<double>, depth int"
)
INFO = "name string, start double, threshold_f1 double, threshold_mcc double, threshold_biz double, features array<string>"
_PARTS = ("feature", "cut", "threshold", "left", "right", "value", "cover")


@dataclass
class Served:
    """What scoring needs: preprocessor, trees, thresholds, feature names."""

    preprocessor: PipelineModel
    model: Boosted
    info: dict

    def score(self, profiles: DataFrame) -> DataFrame:
        return score_boosted(self.preprocessor.transform(profiles), self.model)


def tree_rows(trees: list[Tree]) -> list[tuple]:
    return [(i, *[getattr(t, p).tolist() for p in _PARTS], t.depth) for i, t in enumerate(trees)]


def trees_of(table: DataFrame) -> list[Tree]:
    """The trees in order; their number and size are set by the fit's settings."""
    whole = {"feature": np.int32, "cut": np.int32, "left": np.int32, "right": np.int32}
    rows = table.orderBy("tree").collect()
    return [Tree(*[np.array(r[p], dtype=whole.get(p, np.float64)) for p in _PARTS], r["depth"]) for r in rows]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, ascending."""
    if not _exists(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if _exists(spark, f"{folder}/v{v}/info/_SUCCESS"))


def save_model(spark: SparkSession, folder: str, served: Served) -> int:
    """Write a new version and return its number."""
    version = max(versions(spark, folder), default=0) + 1
    path = f"{folder}/v{version}"
    served.preprocessor.write().overwrite().save(f"{path}/preprocessor")
    write_table(spark.createDataFrame(tree_rows(served.model.trees), TREES).coalesce(1), f"{path}/trees")
    info = {**served.info, "start": float(served.model.start)}
    names = [f.split()[0] for f in INFO.split(", ")]
    write_table(spark.createDataFrame([tuple(info[n] for n in names)], INFO).coalesce(1), f"{path}/info", "json")
    return version


def load_model(spark: SparkSession, folder: str, version: int | None = None) -> Served:
    """A version, the last complete one if not named."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete model version {version or ''} in {folder}")
    path = f"{folder}/v{version or known[-1]}"
    info = spark.read.schema(INFO).json(f"{path}/info").first().asDict()
    model = Boosted(info["start"], trees_of(spark.read.schema(TREES).parquet(f"{path}/trees")))
    return Served(PipelineModel.load(f"{path}/preprocessor"), model, info)


def write_by_tier(portfolio: DataFrame, path: str) -> None:
    """The scored portfolio, a folder per tier; only tiers at hand are replaced."""
    writer = portfolio.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("risk_tier").parquet(path)


def read_by_tier(spark: SparkSession, path: str, tiers: list[str] | None = None) -> DataFrame:
    """The portfolio, or the folders of some tiers alone."""
    df = spark.read.parquet(path)
    return df.filter(F.col("risk_tier").isin(tiers)) if tiers else df
