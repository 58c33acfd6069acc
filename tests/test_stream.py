"""Streams resume from their checkpoint, drop what comes too late, keep bounded
state, keep unscored users, and otherwise equal the batch computation."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from retainlab.plans.q_portfolio import scored_portfolio
from retainlab.sources.tables import table_path
from retainlab.streaming import stream as S

from .conftest import SMALL


def _run():
    return uuid.uuid4().hex[:8]


def test_append_stream_resumes(spark):
    run = _run()
    pf = scored_portfolio(spark, SMALL)
    first = S.run_append(S.score_events(S.event_stream(spark, SMALL), pf), "resume", run_id=run).count()
    again = S.run_append(S.score_events(S.event_stream(spark, SMALL), pf), "resume", run_id=run).count()
    assert first == spark.read.parquet(table_path(SMALL, "events")).count() and again == first


def test_update_stream_equals_batch(spark):
    got = S.run_update(S.sliding_activity(S.event_stream(spark, SMALL)), "batchcmp", ["user_id", "window_start", "window_end"])
    ev = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = S.sliding_activity(ev)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def _events(rows):
    """(day, hour, user) as event rows."""
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(days=d, hours=h), u, "purchase", 1.0) for i, (d, h, u) in enumerate(rows)]


def _write(spark, folder, rows):
    spark.createDataFrame(_events(rows), "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    # parts in the order they were written, one a micro-batch
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_restart_and_state(spark, tmp_path):
    folder, run, keys = str(tmp_path / "events"), _run(), ["day", "user_id"]
    _write(spark, folder, [(0, 1, 1), (0, 2, 1), (0, 3, 2), (3, 5, 1)])
    first = S.run_update(S.user_days(_stream(spark, folder)), "late", keys, run).collect()
    assert sorted((r["day"].day, r["user_id"], r["events"]) for r in first) == [(1, 1, 2), (1, 2, 1), (4, 1, 1)]
    # day 4 is open: its row is updated; day 1 is behind the watermark: its row is dropped
    _write(spark, folder, [(0, 9, 1), (3, 6, 1), (9, 0, 3)])
    _write(spark, folder, [(9, 1, 3)])  # late rows are judged by the watermark of the batch before
    _write(spark, folder, [(3, 7, 1), (9, 2, 3)])
    reports = []
    got = S.run_update(S.user_days(_stream(spark, folder)), "late", keys, run, reports)
    want = [(1, 1, 2), (1, 2, 1), (4, 1, 2), (10, 3, 3)]
    assert sorted((r["day"].day, r["user_id"], r["events"]) for r in got.collect()) == want
    state = [p["stateOperators"][0] for p in reports if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 2
    assert state[-1]["numRowsTotal"] == 1  # only the open window is held
    again = S.run_update(S.user_days(_stream(spark, folder)), "late", keys, run)
    assert sorted((r["day"].day, r["user_id"], r["events"]) for r in again.collect()) == want


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 5)], "k long, n long")
    for epoch, n in ((0, 5), (1, 7), (1, 7)):
        rows.withColumn("n", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
    got = S.latest(spark.read.parquet(log), ["k"]).collect()
    assert [(r["k"], r["n"]) for r in got] == [(1, 7)]


def test_unscored_users_are_kept(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 3), (dt.date(2024, 1, 1), 99, 4), (dt.date(2024, 1, 2), 98, 1)], "day date, user_id long, events long")
    pf = spark.createDataFrame([(1, 0.25, "Low", "train"), (2, 0.75, "High", "train")], "k long, churn_probability double, risk_tier string, split string")
    daily = {(r["day"].day, r["risk_tier"]): (r["events"], r["mean_probability"]) for r in S.risk_daily(days, pf).collect()}
    assert daily == {(1, "Low"): (3, 0.25), (1, S.NOT_SCORED): (4, None), (2, S.NOT_SCORED): (1, None)}
    psi = {r["day"].day: (r["events"], r["unscored"], r["psi"]) for r in S.drift_psi(days, pf, S.baseline_histogram(pf)).collect()}
    assert psi[1][:2] == (3, 4) and psi[1][2] > 0 and psi[2] == (0, 1, None)


def test_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "events")
    _write(spark, folder, [])
    got = S.run_update(S.user_days(_stream(spark, folder)), "empty", ["day", "user_id"])
    assert got.columns == ["day", "user_id", "events"] and got.count() == 0
