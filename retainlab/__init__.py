"""retainlab: churn-risk analytics as Spark jobs.

Sub-packages:
  sources    table readers, fixtures derived from the driver tables, sinks
  functions  column expressions (engineered features, business rules, metrics)
  operators  DataFrame operators (cleaning, preparation, evaluation, diversity,
             calibration, neighbours, portfolio analytics, model fits)
  plans      the query registry and the DuckDB oracle SQL
  streaming  Structured Streaming jobs
"""

from retainlab.session import get_session, checkpoint_dir  # noqa: F401
