"""Local stand-in for the driver's correctness gate: run a Spark query and
its DuckDB SQL twin on the same parquet tables and compare row counts,
column names and the order-insensitive multiset of values."""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsift.sources.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, sql: str, sf_dir: str, con=None, show: int = 3):
    con = con or duck(sf_dir)
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    report = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
              "cols_match": sorted(s_cols) == sorted(d_cols)}
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    report["values_match"] = a == b
    if not report["values_match"]:
        sa, sb = set(a), set(b)
        report["only_spark"] = sorted(sa - sb, key=repr)[:show]
        report["only_oracle"] = sorted(sb - sa, key=repr)[:show]
        if not report["cols_match"]:
            report["cols"] = (sorted(s_cols), sorted(d_cols))
    return report
