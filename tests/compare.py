"""Run a query in Spark and its oracle in DuckDB and compare values, columns sorted by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" + ("" if p.is_file() else "/*.parquet"))
    return con


def _norm(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(names: list[str], data: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in data)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)], [x for x in theirs if x not in set(mine)]
        return f"{len(mine)} rows against {len(theirs)}; only here {a[:3]}; only there {b[:3]}"
    return ""
