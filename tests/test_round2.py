"""Faults that no fixture reaches: large counts, odd shares, folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retainlab.operators import evaluate, prepare
from retainlab.streaming.stream import event_stream

from .conftest import SMALL


def test_auc_of_billions_of_rows(spark, monkeypatch):
    n = 4 * 10**9
    ties = spark.createDataFrame([("m", 0.9, n, 0, n, 0), ("m", 0.5, n, n, 2 * n, n)], "model string, score double, pos long, neg long, cum_pos long, cum_neg long")
    monkeypatch.setattr(evaluate, "tie_groups", lambda scores, group: ties)
    assert evaluate.roc_auc(ties).first()["roc_auc"] == 0.75
    assert evaluate.curve_stats(ties).first()["roc_auc"] == 0.75


@pytest.mark.parametrize(("train", "val", "sizes"), [(0.75, 0.05, (750, 50, 200)), (0.6, 0.0, (600, 0, 400)), (0.7, 0.1, (700, 100, 200))])
def test_split_shares(spark, train, val, sizes):
    df = spark.range(2000).select(F.col("id").alias("k"), F.xxhash64("id").alias("h"), (F.col("id") % 2).alias("y_true"))
    got = {(r["y_true"], r["split"]): r["n"] for r in prepare.stratified_exact_split(df, "h", "k", train=train, val=val).groupBy("y_true", "split").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        assert tuple(got.get((y, s), 0) for s in ("train", "val", "test")) == sizes


def test_split_without_test_part(spark):
    with pytest.raises(ValueError):
        prepare.stratified_exact_split(spark.range(1).selectExpr("id k", "id h", "id y_true"), "h", "k", train=0.9, val=0.1)


def test_stream_of_a_folder(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    q = event_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("folder_events").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("folder_events").count() == events.count()
