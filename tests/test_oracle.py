"""Every query with oracle SQL equals DuckDB on the sf0.001 tables
(rows, column names, values); queries without one run and return rows."""

import math

import pytest

from retainlab.plans.registry import all_oracle_sql, all_queries

from .conftest import SMALL

QUERIES = all_queries()
ORACLE = all_oracle_sql()
SLOW = {n for n in QUERIES if n.startswith(("fit_", "tune_", "train_"))} | {"portfolio_trained", "calibration_summary"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(cols, rows, order):
    idx = [cols.index(c) for c in order]
    return sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    assert _rows(df.columns, rows, order) == _rows(ocols, res.fetchall(), order)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and n not in SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
