"""Run registered queries against their SQL on DuckDB and compare values.

    python -m tests.oracle sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [names[i] for i in order]


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def compare(spark, con, folder: str, name: str, query) -> tuple[str, float]:
    start = time.time()
    df = query(spark, folder)
    got = df.collect()
    took = time.time() - start
    return df, got, took


def check(df, got, con, sql: str) -> str:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want, want_names = rows_of(names, rel.fetchall())
    have, have_names = rows_of(df.columns, got)
    if want_names != have_names:
        return f"columns {have_names} vs {want_names}"
    if len(want) != len(have):
        return f"rows {len(have)} vs {len(want)}"
    for h, w in zip(have, want):
        if not all(close(x, y) for x, y in zip(h, w)):
            return f"row {h} vs {w}"
    return "ok"


def main() -> int:
    import __spark_entry__ as entry

    from tablescope.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = local_session(8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        try:
            df, got, took = compare(spark, con, folder, name, queries[name])
            start = time.time()
            verdict = check(df, got, con, oracles[name]) if name in oracles else f"rows-only {len(got)}"
            sql_took = time.time() - start
        except Exception as e:  # noqa: BLE001
            verdict, took, sql_took, got = f"FAILED {type(e).__name__}: {str(e)[:700]}", 0.0, 0.0, []
        if verdict != "ok" and not verdict.startswith("rows-only"):
            bad += 1
        print(f"{name:32s} {took:7.2f}s {sql_took:6.2f}s {len(got):7d} {verdict}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
