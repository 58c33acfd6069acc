"""Plan shape: the flagship scan reads only the columns it needs."""

import contextlib
import io
import os

from .conftest import SMALL


def _explain(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_flagship_prunes_columns(spark):
    os.environ["RETAINLAB_CACHE"] = "0"
    try:
        import __spark_entry__ as e

        plan = _explain(e.queries()["revenue_breakdown"](spark, SMALL))
    finally:
        os.environ.pop("RETAINLAB_CACHE")
    schemas = [line for line in plan.splitlines() if line.strip().startswith("ReadSchema")]
    orders = [s for s in schemas if "o_custkey" in s]
    assert orders and all("o_totalprice" not in s and "o_orderkey" not in s for s in orders)
    assert "Expand" in plan  # GROUPING SETS in one scan
