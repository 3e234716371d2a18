"""Order-insensitive comparison of a registered query with its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v + 0.0)
        return v

    made = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when both agree exactly, else what differs first."""
    left = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right = rows([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(y) for y in b]:
            parts = [(c, x, y) for c, x, y in zip(left[0], a, b) if x != y or type(x) is not type(y)]
            wrong = sum(x != y for x, y in zip(left[1], right[1]))
            return f"{wrong} rows differ, first {parts}"
    return None
