"""Streaming queries T1-T4: each runs a Structured Streaming job over the
events file to the end of its input (availableNow) and returns the sink
table, or a result of it; the oracle is the batch form of the same computation."""

from __future__ import annotations

from retainlab.plans.q_portfolio import LEVEL, scored_portfolio
from retainlab.plans.registry import query
from retainlab.streaming import stream as S

_EVJ = "FROM events e LEFT JOIN portfolio p ON p.k = e.user_id"


@query("stream_scoring", f"""
SELECT e.event_id, e.user_id, p.customerID, e.event_type, round(p.churn_probability, 4) AS churn_probability,
       p.churn_probability >= 0.5 AS churn_prediction,
       CASE WHEN p.churn_probability IS NULL THEN 'not scored' ELSE {LEVEL.format(p='p.churn_probability')} END AS risk_level,
       CASE WHEN p.churn_probability >= 0.5 THEN 50.0::DOUBLE ELSE round(p.churn_probability * 500.0, 2) END
         AS expected_cost
{_EVJ}
""")
def q_stream_scoring(spark, sf_dir):
    ev = S.event_stream(spark, sf_dir)
    return S.run_append(S.score_events(ev, scored_portfolio(spark, sf_dir)), "scoring")


def _days(spark, sf_dir):
    return S.run_update(S.user_days(S.event_stream(spark, sf_dir)), "user_days", ["day", "user_id"])


@query("stream_risk_daily", f"""
SELECT CAST(date_trunc('day', e.ts) AS DATE) AS day, coalesce(p.risk_tier, 'not scored') AS risk_tier, count(*) AS events,
       round(sum(p.churn_probability) / count(*), 4) AS mean_probability
{_EVJ} GROUP BY 1, 2
""")
def q_stream_risk_daily(spark, sf_dir):
    return S.risk_daily(_days(spark, sf_dir), scored_portfolio(spark, sf_dir))


@query("sliding_activity", """
, w AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) - CAST(i AS INTEGER) AS ws, value, event_type
        FROM events, range(7) t(i))
SELECT user_id, ws AS window_start, ws + 7 AS window_end, count(*) AS events, round(sum(value), 4) AS value_sum,
       count_if(event_type = 'purchase') AS purchases
FROM w GROUP BY user_id, ws
""")
def q_sliding_activity(spark, sf_dir):
    ev = S.event_stream(spark, sf_dir)
    return S.run_update(S.sliding_activity(ev), "sliding", ["user_id", "window_start", "window_end"])


@query("drift_psi", f"""
, bh AS (SELECT least(CAST(floor(churn_probability * 10) AS INTEGER), 9) AS bin, count(*) AS n FROM portfolio
           WHERE split = 'train' GROUP BY 1),
bt AS (SELECT sum(n) AS t FROM bh),
bins AS (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)),
ex AS (SELECT bins.bin, greatest(coalesce(CAST(bh.n AS DOUBLE) / bt.t, 0.0), 0.0001) AS e
       FROM bins LEFT JOIN bh USING (bin), bt),
c AS (SELECT CAST(date_trunc('day', e.ts) AS DATE) AS day,
             CASE WHEN p.k IS NOT NULL THEN least(CAST(floor(p.churn_probability * 10) AS INTEGER), 9) END AS bin,
             count(*) AS n {_EVJ} GROUP BY 1, 2),
d AS (SELECT day, coalesce(sum(n) FILTER (bin IS NOT NULL), 0)::BIGINT AS events,
             coalesce(sum(n) FILTER (bin IS NULL), 0)::BIGINT AS unscored FROM c GROUP BY day),
x AS (SELECT d.day, d.events, d.unscored, ex.bin, ex.e, greatest(coalesce(coalesce(c.n, 0) / d.events, 0.0), 0.0001) AS a
      FROM d CROSS JOIN ex LEFT JOIN c ON c.day = d.day AND c.bin = ex.bin)
SELECT day, events, unscored, CASE WHEN events > 0 THEN round(sum((a - e) * ln(a / e)), 6) END AS psi
FROM x GROUP BY day, events, unscored
""")
def q_drift_psi(spark, sf_dir):
    pf = scored_portfolio(spark, sf_dir)
    return S.drift_psi(_days(spark, sf_dir), pf, S.baseline_histogram(pf))
