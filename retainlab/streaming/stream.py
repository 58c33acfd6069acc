"""Structured Streaming jobs T1-T4 over the ``events`` table read as a file
stream.

Sources: ``readStream.parquet`` on the scale folder with a glob on the events
file (explicit schema). ``ts`` arrives as TIMESTAMP_NTZ; it is cast to
TIMESTAMP (session zone) because ``withWatermark`` needs it.

Aggregates run in update mode: a micro-batch emits the windows it changed, a
window behind the watermark leaves the state, and rows that come later than that
are dropped. The changed rows of micro-batch n go to the folder ``epoch=n`` of an
update log, so a batch that is run again after a failure replaces its own rows;
the table is the latest row of each key. Streams aggregate by window and user
before anything is joined, so a user with many events is one row per window;
users without a score are kept as "not scored". Sinks and stream checkpoints lie
under the session's shared checkpoint folder, and a restarted job resumes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainlab import config as C
from retainlab.functions import rules as R
from retainlab.session import scratch_path
from retainlab.sources.tables import table_path


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events table as a stream, be it a folder of parts or one file."""
    table = table_path(sf_dir, "events")
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        s = reader.parquet(table)
    else:
        s = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


NOT_SCORED = "not scored"


def _paths(spark: SparkSession, name: str, run_id: str | None = None) -> tuple[str, str]:
    """Sink and checkpoint folders; a stable ``run_id`` lets a restarted job
    resume from its checkpoint, none gives a fresh run."""
    run = f"stream-{name}-{run_id or uuid.uuid4().hex[:8]}"
    return scratch_path(spark, f"{run}/out"), scratch_path(spark, f"{run}/checkpoint")


def run_append(df: DataFrame, name: str, run_id: str | None = None) -> DataFrame:
    """Append-mode stream to a parquet table, run to the end of the input."""
    spark = df.sparkSession
    out, ckpt = _paths(spark, name, run_id)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_update(df: DataFrame, name: str, keys: list[str], run_id: str | None = None, progress: list | None = None) -> DataFrame:
    """Update-mode aggregate into an update log, run to the end of the input;
    returns the latest row of each key. ``progress`` gets the batches' reports."""
    spark = df.sparkSession
    out, ckpt = _paths(spark, name, run_id)
    schema, columns = df.schema, list(df.columns)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no input at all
        return spark.createDataFrame([], schema)
    logged = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    return latest(spark.read.schema(logged).parquet(out), keys).select(columns)


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from its last epoch."""
    rest = [c for c in log.columns if c not in (*keys, "epoch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("epoch")).alias("_r")).select(*keys, "_r.*")


# ------------------------------------------------------------------- T1
def score_events(events: DataFrame, portfolio: DataFrame, default_threshold: float = C.DEFAULT_THRESHOLD,
                 cost_fn: float = C.COST_FN, cost_fp: float = C.COST_FP) -> DataFrame:
    """Stream-static left join on the customer key, then the prediction rule;
    events of customers without a score have the level "not scored"."""
    pf = portfolio.select(F.col("k").alias("user_id"), C.ID_COL, "churn_probability")
    j = events.join(pf, "user_id", "left")
    p = F.col("churn_probability")
    flagged = p >= F.lit(default_threshold)
    return j.select(
        "event_id", "user_id", C.ID_COL, "event_type",
        F.round(p, 4).alias("churn_probability"),
        flagged.alias("churn_prediction"),
        F.when(p.isNotNull(), R.risk_level(p)).otherwise(NOT_SCORED).alias("risk_level"),
        F.when(flagged, F.lit(cost_fp)).otherwise(F.round(p * cost_fn, 2)).alias("expected_cost"),
    )


# ------------------------------------------------------------------- T2
def user_days(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Stream of events per tumbling day and user."""
    g = events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("events")).select(F.to_date(F.col("w.start")).alias("day"), "user_id", "events")


def risk_daily(days: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Events and mean probability per day and risk tier, unscored users apart."""
    pf = portfolio.select(F.col("k").alias("user_id"), "churn_probability", "risk_tier")
    j = days.join(pf, "user_id", "left").withColumn("risk_tier", F.coalesce("risk_tier", F.lit(NOT_SCORED)))
    return j.groupBy("day", "risk_tier").agg(
        F.sum("events").alias("events"),
        F.round(F.sum(F.col("events") * F.col("churn_probability")) / F.sum("events"), 4).alias("mean_probability"),
    )


# ------------------------------------------------------------------- T3
def sliding_activity(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Per user and 7-day window sliding by 1 day: events, value, purchases."""
    g = events.withWatermark("ts", watermark).groupBy(
        "user_id", F.window("ts", "7 days", "1 day").alias("w")
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("value").alias("_v"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    )
    return g.select(
        "user_id", F.to_date(F.col("w.start")).alias("window_start"), F.to_date(F.col("w.end")).alias("window_end"),
        "events", F.round("_v", 4).alias("value_sum"), "purchases",
    )


# ------------------------------------------------------------------- T4
PSI_BINS = 10
PSI_FLOOR = 1e-4


def prob_bin(p) -> F.Column:
    return F.least(F.floor(p * PSI_BINS), F.lit(PSI_BINS - 1)).cast("int")


def baseline_histogram(portfolio: DataFrame, split: str = "train") -> DataFrame:
    """Share of customers per probability bin on the baseline split (<= 10 rows)."""
    b = portfolio.filter(F.col("split") == split).groupBy(prob_bin(F.col("churn_probability")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = b.agg(F.sum("n").alias("_t"))
    return b.crossJoin(tot).select("bin", (F.col("n") / F.col("_t")).alias("expected"))


def drift_psi(days: DataFrame, portfolio: DataFrame, baseline: DataFrame) -> DataFrame:
    """PSI of each day's scored events against the baseline histogram, with the
    number of scored and of unscored events."""
    spark = baseline.sparkSession
    bins = spark.range(PSI_BINS).select(F.col("id").cast("int").alias("bin"))
    base = bins.join(baseline, "bin", "left").select(
        "bin", F.greatest(F.coalesce("expected", F.lit(0.0)), F.lit(PSI_FLOOR)).alias("e"))
    pf = portfolio.select(F.col("k").alias("user_id"), prob_bin(F.col("churn_probability")).alias("bin"))
    c = days.join(pf, "user_id", "left").groupBy("day", "bin").agg(F.sum("events").alias("n"))
    per = c.groupBy("day").agg(
        F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0)).alias("unscored"),
    )
    grid = per.crossJoin(F.broadcast(base))  # 10 bins per day
    x = grid.join(c.filter(F.col("bin").isNotNull()), ["day", "bin"], "left").withColumn(
        "a", F.greatest(F.coalesce(F.try_divide(F.coalesce(F.col("n"), F.lit(0)), F.col("events")), F.lit(0.0)), F.lit(PSI_FLOOR)))
    psi = F.round(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))), 6)
    return x.groupBy("day", "events", "unscored").agg(F.when(F.col("events") > 0, psi).alias("psi"))
