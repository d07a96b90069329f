"""Holds a query's rows against those of its SQL in DuckDB, over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def views(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f'CREATE VIEW "{p.name.removesuffix(".parquet")}" AS SELECT * FROM read_parquet(\'{at}\')')
    return con


def canon(v: object) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def row_set(rows: list[tuple], columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(canon(r[i]) for i in order)) for r in rows)


def spark_rows(df) -> tuple[list[str], list[str], dict[str, str]]:
    kinds = dict(df.dtypes)
    return sorted(df.columns), row_set([tuple(r) for r in df.collect()], df.columns), kinds


def duck_rows(con, sql: str) -> tuple[list[str], list[str], dict[str, str]]:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    return sorted(columns), row_set(cur.fetchall(), columns), kinds


#: Types that hold the same values on both sides.
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def differences(df, con, sql: str) -> list[str]:
    sc, sr, sk = spark_rows(df)
    dc, dr, dk = duck_rows(con, sql)
    out = []
    if sc != dc:
        out.append(f"columns {sc} and {dc}")
    if len(sr) != len(dr):
        out.append(f"rows {len(sr)} and {len(dr)}")
    out += [f"type of {c}: {sk[c]} and {dk[c]}" for c in sc if c in dk and SAME.get(sk[c], sk[c]) != dk[c]]
    if sr != dr:
        a, b = sorted(set(sr) - set(dr))[:3], sorted(set(dr) - set(sr))[:3]
        out.append(f"only in Spark {a}, only in SQL {b}")
    return out
