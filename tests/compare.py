"""Compare a Spark result with the result of the SQL counterpart, whole tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, con, sql: str, most: int = 3) -> list[str]:
    spark_rows = rows_of(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    other_rows = rows_of(names, result.fetchall())
    out = []
    if sorted(names) != sorted(spark_df.columns):
        out.append(f"columns {sorted(spark_df.columns)} / {sorted(names)}")
    if len(spark_rows) != len(other_rows):
        out.append(f"rows {len(spark_rows)} / {len(other_rows)}")
    unequal = [(a, b) for a, b in zip(spark_rows, other_rows) if a != b]
    out += [f"{len(unequal)} unequal: {str(a)[:300]} / {str(b)[:300]}" for a, b in unequal[:most]]
    return out
