"""Compare a Spark query with its DuckDB oracle: row count, column names and
an order-insensitive comparison of the values (floats to 1e-6)."""

from __future__ import annotations

import datetime as _dt
import math

import duckdb
import pandas as pd

from communitylens.sources.tables import RAW_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict, str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return tuple(_norm(x) for x in list(v))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(records: list[dict], cols: list[str]) -> list[tuple]:
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: repr(t))


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> dict:
    s_rows = [r.asDict(recursive=True) for r in spark_df.collect()]
    s_cols = list(spark_df.columns)
    dres = con.execute(sql)
    d_cols = [d[0] for d in dres.description]
    d_rows = [dict(zip(d_cols, r)) for r in dres.fetchall()]
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols), "spark_cols": s_cols, "oracle_cols": d_cols}
    if not res["cols_match"]:
        res["ok"] = False
        return res
    cols = sorted(s_cols)
    a, b = rows_of(s_rows, cols), rows_of(d_rows, cols)
    res["values_match"] = a == b
    if not res["values_match"]:
        sa, sb = set(a), set(b)
        diff_a = [x for x in a if x not in sb][:3]
        diff_b = [x for x in b if x not in sa][:3]
        res["only_spark"] = diff_a
        res["only_oracle"] = diff_b
    res["ok"] = res["values_match"] and len(s_rows) == len(d_rows)
    return res
