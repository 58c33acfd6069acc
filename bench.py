"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (the whole plan
executes, nothing is collected). Cold = first run in the session, warm =
second run. Shuffle bytes per query come from Spark's event log written to a
fresh scratch folder. Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "revenue_breakdown",
    "portfolio_summary",
    "campaign_targets",
    "campaign_roi_curve",
    "strategy_comparison",
    "segment_analysis",
    "customer_interventions",
    "top_factors",
    "confusion",
    "roc_auc",
    "average_precision",
    "threshold_sweep",
    "leaderboard",
    "pairwise_diversity",
    "subset_vote_f1",
    "ece",
    "reliability",
    "knn_join",
    "knora_u",
    "dedupe_profiles",
    "impute_median",
    "onehot_long",
    "exact_stratified_split",
    "stream_risk_daily",
    "fit_logistic_regression",
]


def shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group from the event log."""
    stage_group: dict[int, str] = {}
    out: dict[str, int] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    if group:
                        out[group] = out.get(group, 0) + int(m.get("Shuffle Bytes Written", 0))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    names = sys.argv[1:] or HEADLINE
    log_dir = tempfile.mkdtemp(prefix="bench-eventlog-", dir="/tmp")
    from retainlab.session import get_session

    spark = get_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(2 * cpus, 4)),
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": log_dir,
            "spark.eventLog.rolling.enabled": "false",
            "spark.eventLog.compress": "false",
        },
    )
    from retainlab.plans.registry import all_queries

    qs = all_queries()
    cold, warm = {}, {}
    for name in names:
        for label, store in (("cold", cold), ("warm", warm)):
            spark.sparkContext.setJobGroup(f"{name}:{label}", name)
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.time() - t0, 3)
    spark.sparkContext.setJobGroup("done", "done")
    spark.stop()
    sb = shuffle_bytes(log_dir)
    result = {
        "metric": "warm_seconds_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "shuffle_bytes": {n: sb.get(f"{n}:warm", 0) for n in names},
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
