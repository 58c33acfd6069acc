"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from retainlab.plans.registry import all_oracle_sql, all_queries  # noqa: E402
from retainlab.session import get_session  # noqa: E402
from retainlab.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    qs, sql = all_queries(), all_oracle_sql()
    names = args or sorted(qs)
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = df.collect()
            cols = df.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sql:
            print(f"ROWS {name}: {len(rows)} rows ({dt:.1f}s) [no oracle]")
            continue
        try:
            res = con.execute(sql[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad += 1
            continue
        stype = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        dtype = {d[0]: str(d[1]) for d in res.description}
        tmap = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}
        tdiff = {c: (stype[c], dtype[c]) for c in cols
                 if tmap.get(stype[c], stype[c]).upper() != dtype[c].upper() and not
                 (stype[c].startswith("array") or dtype[c].endswith("[]"))}
        if tdiff:
            print(f"TYPE {name}: {tdiff}")
        order = sorted(cols)
        si = [cols.index(c) for c in order]
        oi = [ocols.index(c) for c in order]
        a = sorted((tuple(norm(r[i]) for i in si) for r in rows), key=repr)
        b = sorted((tuple(norm(r[i]) for i in oi) for r in orows), key=repr)
        if a != b:
            bad += 1
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; cols {order}\n  spark only {diff_a}\n  duck only {diff_b}")
        else:
            print(f"OK   {name}: {len(a)} rows ({dt:.1f}s)")
    print(f"{bad} failing of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
